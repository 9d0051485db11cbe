"""Event-time streams over the ledger, arriving in waves with late events; each wave restarts the stream from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.plans.registry import query
from curatorium.session import ensure_checkpoint_dir
from curatorium.sources.projections import CTES, Tables
from curatorium.streaming import attempt_stream as S

c = F.col

HOUR = 3_600_000
DELAY_HOURS, TIMEOUT_HOURS = 6, 36  # an attempt is a user's day, so an event on time finds its attempt open

# every eleventh event arrives three days late, every third two hours; ten days of arrivals are a wave
CTES["arrivals"] = (
    (),
    """SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(arrived AS DATE)) / 10) AS BIGINT) AS wave FROM (
         SELECT event_id AS seq, user_id AS owner, user_id || ':' || strftime(ts, '%Y-%m-%d') AS attempt, ts,
           ts + to_hours(CASE WHEN event_id % 11 = 0 THEN 72 WHEN event_id % 3 = 0 THEN 2 ELSE 0 END) AS arrived,
           CASE event_type WHEN 'signup' THEN 'INTENT' WHEN 'view' THEN 'FETCHING' WHEN 'click' THEN 'RESPONSE' WHEN 'purchase' THEN 'TERMINAL' ELSE 'FAILED' END AS lifecycle,
           CASE WHEN event_type = 'purchase' THEN CASE WHEN round(value * 100) < 1000 THEN 'PROVABLY_NOT_DISPATCHED' ELSE 'COMPLETED' END END AS disposition,
           CAST(round(value * 100) AS BIGINT) AS cost_cents
         FROM events)""",
)


def arrivals(t: Tables) -> DataFrame:
    hours = F.when(c("event_id") % 11 == 0, 72).when(c("event_id") % 3 == 0, 2).otherwise(0)
    kind, cost = c("event_type"), F.round(c("value") * 100).cast("bigint")
    rows = t.raw("events").select(
        c("event_id").alias("seq"), c("user_id").alias("owner"), F.concat_ws(":", c("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("attempt"),
        c("ts").cast("timestamp").alias("ts"), (c("ts").cast("timestamp") + F.make_dt_interval(hours=hours)).alias("arrived"),
        F.when(kind == "signup", "INTENT").when(kind == "view", "FETCHING").when(kind == "click", "RESPONSE").when(kind == "purchase", "TERMINAL").otherwise("FAILED").alias("lifecycle"),
        F.when(kind == "purchase", F.when(cost < 1000, "PROVABLY_NOT_DISPATCHED").otherwise("COMPLETED")).alias("disposition"), cost.alias("cost_cents"),
    )
    return rows.withColumn("wave", F.floor(F.datediff("arrived", F.lit("2024-01-01")) / 10).cast("bigint"))


def in_waves(t: Tables, step: Callable[[DataFrame, str], None]) -> str:
    """Write the arrivals wave by wave and run ``step(stream, folder)`` after each, as a restarted job would."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/waves-{uuid.uuid4().hex}"
    rows = arrivals(t)
    first, last = rows.agg(F.coalesce(F.min("wave"), F.lit(0)), F.coalesce(F.max("wave"), F.lit(0))).first()
    for wave in range(first, last + 1):  # a wave is ten days, whatever it holds
        rows.where(c("wave") == wave).write.mode("append").parquet(f"{folder}/in")
        step(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)
    return folder


MARKS = f"""top AS (SELECT wave, (epoch_us(max(arrived)) // 1000) AS top_ms FROM arrivals GROUP BY wave),
       marks AS (SELECT wave, coalesce(max(top_ms) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_HOURS * HOUR}, 0) AS mark, max(top_ms) OVER () - {DELAY_HOURS * HOUR} AS final FROM top)"""


@query(
    "timed_attempts_stream",
    ["arrivals"],
    f"""{MARKS},
       e AS (SELECT *, (epoch_us(ts) // 1000) AS ts_ms, (epoch_us(ts) // 1000) < mark AS late FROM arrivals JOIN marks USING (wave)),
       a AS (SELECT attempt, count(*) AS events, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(final) AS final, bool_or(disposition IS NOT DISTINCT FROM 'PROVABLY_NOT_DISPATCHED') AS u, bool_or(lifecycle = 'TERMINAL') AS t, bool_or(lifecycle = 'RESPONSE') AS r FROM e WHERE NOT late GROUP BY attempt)
       SELECT 'LATE' AS kind, attempt, seq, CAST(NULL AS BIGINT) AS events, ts_ms AS first_ms, ts_ms AS last_ms, CAST(NULL AS VARCHAR) AS status FROM e WHERE late
       UNION ALL SELECT 'CLOSED', attempt, NULL, events, first_ms, last_ms, CASE WHEN u THEN 'PROVABLY_NOT_DISPATCHED' WHEN t THEN 'COMPLETED' WHEN r THEN 'DURABLE_RESPONSE' ELSE 'UNKNOWN_IN_FLIGHT' END FROM a WHERE last_ms + {TIMEOUT_HOURS * HOUR} <= final""",
)
def _(t):
    folder = in_waves(t, lambda stream, f: S.run_timed_attempts(stream, f"{DELAY_HOURS} hours", TIMEOUT_HOURS * HOUR, f"{f}/out", f"{f}/checkpoint"))
    found = t.spark.read.schema(S.OUTPUT).parquet(f"{folder}/out")
    closed = S.closed_attempts(found).select(F.lit("CLOSED").alias("kind"), "attempt", F.lit(None).cast("bigint").alias("seq"), "events", "first_ms", "last_ms", "status")
    late = S.late_events(found).select(F.lit("LATE").alias("kind"), "attempt", "seq", F.lit(None).cast("bigint").alias("events"), c("ts_ms").alias("first_ms"), c("ts_ms").alias("last_ms"), F.lit(None).cast("string").alias("status"))
    return closed.unionByName(late)


# a window drops an event once the watermark has passed its end, and is written once the last watermark has
EVENT_MARKS = """top AS (SELECT wave, (epoch_us(max(ts)) // 1000) AS top_ms FROM arrivals GROUP BY wave),
       marks AS (SELECT wave, coalesce(max(top_ms) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 24 * 3600000, 0) AS mark, max(top_ms) OVER () - 24 * 3600000 AS final FROM top)"""


@query(
    "tumbling_windows_stream",
    ["arrivals"],
    f"""{EVENT_MARKS},
       e AS (SELECT *, date_trunc('day', ts) AS starts FROM arrivals JOIN marks USING (wave))
       SELECT CAST(starts AS VARCHAR)[1:10] AS starts, lifecycle, count(*) AS events, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM e
       WHERE (epoch_us(starts) // 1000) + 24 * 3600000 > mark AND (epoch_us(starts) // 1000) + 24 * 3600000 <= final GROUP BY ALL""",
)
def _(t):
    folder = in_waves(t, lambda stream, f: S.run_windows(S.window_totals(stream, "1 day", None, ["lifecycle"], "24 hours"), f"{f}/out", f"{f}/checkpoint"))
    return t.spark.read.parquet(f"{folder}/out").select(F.date_format("starts", "yyyy-MM-dd").alias("starts"), "lifecycle", "events", "cost_cents")


@query(
    "sliding_windows_stream",
    ["arrivals"],
    f"""{EVENT_MARKS},
       e AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS starts FROM arrivals JOIN marks USING (wave))
       SELECT CAST(starts AS VARCHAR)[1:10] AS starts, count(*) AS events, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM e
       WHERE (epoch_us(starts) // 1000) + 48 * 3600000 > mark AND (epoch_us(starts) // 1000) + 48 * 3600000 <= final GROUP BY ALL""",
)
def _(t):
    folder = in_waves(t, lambda stream, f: S.run_windows(S.window_totals(stream, "2 days", "1 day", [], "24 hours"), f"{f}/out", f"{f}/checkpoint"))
    return t.spark.read.parquet(f"{folder}/out").select(F.date_format("starts", "yyyy-MM-dd").alias("starts"), "events", "cost_cents")


@query(
    "session_windows_stream",
    ["ledger"],
    """e AS (SELECT user_id AS owner, (epoch_us(ts) // 1000) AS ms, CAST(round(value * 100) AS BIGINT) AS cost FROM events),
       n AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 12 * 3600000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY owner ORDER BY ms)),
       s AS (SELECT *, sum(opens) OVER (PARTITION BY owner ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM n)
       SELECT owner, min(ms) AS first_ms, max(ms) + 12 * 3600000 AS ends_ms, count(*) AS events, CAST(sum(cost) AS BIGINT) AS cost_cents FROM s GROUP BY owner, session
       HAVING max(ms) + 12 * 3600000 <= (SELECT max(ms) FROM e) - 24 * 3600000""",
)
def _(t):
    # one arrival of everything: sessions that can't grow any more are written
    folder = f"{ensure_checkpoint_dir(t.spark)}/sessions-{uuid.uuid4().hex}"
    arrivals(t).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(arrivals(t).schema).parquet(f"{folder}/in").select("owner", F.timestamp_millis(F.unix_millis("ts")).alias("ts"), "cost_cents")
    S.run_windows(S.session_totals(stream, "12 hours", ["owner"], "24 hours"), f"{folder}/out", f"{folder}/checkpoint")
    found = t.spark.read.parquet(f"{folder}/out")
    return found.select("owner", F.unix_millis("starts").alias("first_ms"), F.unix_millis("ends").alias("ends_ms"), "events", "cost_cents")


@query(
    "answered_stream",
    (),
    """e AS (SELECT event_id AS seq, user_id AS owner, event_type, epoch_us(ts) AS us FROM events),
       a AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT * FROM e WHERE event_type = 'click'),
       f AS (SELECT (least((SELECT max(us) FROM a), (SELECT max(us) FROM r)) // 1000 - 12 * 3600000) * 1000 AS final)
       SELECT a.owner, a.seq, r.seq AS answer_seq FROM a LEFT JOIN r ON r.owner = a.owner AND r.us BETWEEN a.us AND a.us + 36000000000, f WHERE r.seq IS NOT NULL OR a.us + 36000000000 < final""",
)
def _(t):
    # answers within ten hours; questions that may still be answered are not written
    folder = f"{ensure_checkpoint_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    rows = t.raw("events").select(c("event_id").alias("seq"), c("user_id").alias("owner"), c("ts").cast("timestamp").alias("ts"), "event_type")
    rows.where("event_type IN ('signup', 'click')").write.parquet(f"{folder}/in")
    read = lambda kind: t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in").where(c("event_type") == kind)
    S.run_windows(S.answered(read("signup"), read("click"), "owner", "10 hours", "12 hours"), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").select("owner", "seq", "answer_seq")


@query("events_once_stream", ["arrivals"], "SELECT seq, owner, lifecycle FROM arrivals")
def _(t):
    # a third of the events arrive twice, the second time with the next wave or within their own
    folder = f"{ensure_checkpoint_dir(t.spark)}/once-{uuid.uuid4().hex}"
    rows = arrivals(t).select("seq", "owner", "lifecycle", "ts")
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    for part in (rows.unionByName(rows.where("seq % 6 = 0")), rows.where("seq % 6 = 3")):
        part.write.mode("append").parquet(f"{folder}/in")
        S.run_windows(S.once(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "seq", "40 days"), out, checkpoint)
    return t.spark.read.parquet(out).select("seq", "owner", "lifecycle")
