"""Ledger replay, decision checks and promotion checks over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import digest, joined
from curatorium.functions.spread import integer_bucket, ranked
from curatorium.operators import ledger as L
from curatorium.operators import rules
from curatorium.plans.joins import HASHES
from curatorium.plans.registry import query
from curatorium.session import ensure_checkpoint_dir, stored
from curatorium.sources.projections import CTES, Tables
from curatorium.streaming import ledger_stream

c = F.col

# an attempt is one user on one day
CTES["attempts"] = (
    ("ledger",),
    """SELECT seq, attempt_id || ':' || strftime(day, '%Y-%m-%d') AS attempt, attempt_id AS owner, day, lifecycle, cost_cents, payload,
       CASE WHEN lifecycle = 'TERMINAL' THEN CASE WHEN cost_cents < 1000 THEN 'PROVABLY_NOT_DISPATCHED' ELSE 'COMPLETED' END END AS disposition FROM ledger""",
)


def attempts(t: Tables) -> DataFrame:
    terminal = c("lifecycle") == "TERMINAL"
    return t.ledger.select(
        "seq", F.concat_ws(":", c("attempt_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("attempt"), c("attempt_id").alias("owner"), "day",
        "lifecycle", "cost_cents", "payload",
        F.when(terminal & (c("cost_cents") < 1000), "PROVABLY_NOT_DISPATCHED").when(terminal, "COMPLETED").alias("disposition"),
    )


@query(
    "attempt_status",
    ["attempts"],
    """p AS (SELECT attempt FROM attempts UNION SELECT owner || ':' || strftime(day + 1, '%Y-%m-%d') FROM attempts),
       f AS (SELECT attempt, bool_or(disposition IS NOT DISTINCT FROM 'PROVABLY_NOT_DISPATCHED') AS u, bool_or(lifecycle = 'TERMINAL') AS t, bool_or(lifecycle = 'RESPONSE') AS r FROM attempts GROUP BY attempt)
       SELECT attempt, CASE WHEN t IS NULL THEN 'NO_DURABLE_ATTEMPT' WHEN u THEN 'PROVABLY_NOT_DISPATCHED' WHEN t THEN 'COMPLETED' WHEN r THEN 'DURABLE_RESPONSE' ELSE 'UNKNOWN_IN_FLIGHT' END AS status FROM p LEFT JOIN f USING (attempt)""",
)
def _(t):
    # planned: every attempt and a follow-up on the next day
    rows = attempts(t)
    later = F.concat_ws(":", c("owner").cast("string"), F.date_format(F.date_add("day", 1), "yyyy-MM-dd"))
    planned = rows.select("attempt").unionByName(rows.select(later.alias("attempt")))
    return L.attempt_status(planned, rows, "attempt")


@query(
    "chain_validate",
    ["ledger"],
    """d AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) - 1 AS pos, cost_cents > 25000 AND lifecycle = 'INTENT' AS gone, cost_cents > 30000 AND lifecycle = 'FAILED' AS rewritten, cost_cents > 30000 AND lifecycle = 'FETCHING' AS rehashed FROM ledger),
       b AS (SELECT *, lag(gone) OVER w AS after_gone, lag(rehashed) OVER w AS after_rehashed FROM d WINDOW w AS (PARTITION BY day ORDER BY pos))
       SELECT day, pos, CASE WHEN after_gone THEN 'SEQUENCE_GAP' WHEN after_rehashed THEN 'BROKEN_LINK' ELSE 'HASH_MISMATCH' END AS problem FROM b WHERE NOT gone AND (after_gone OR after_rehashed OR rewritten)""",
)
def _(t):
    # one ledger a day
    daily = ranked(t.ledger, ["day"], [c("seq").asc()], [(integer_bucket("seq"), True)], out="pos").withColumn("pos", c("pos") - 1)
    fields = ["lifecycle", "payload"]
    sealed = stored(L.seal(daily.select("day", "pos", *fields, "cost_cents"), "pos", fields, ["day"]), "sealed")
    # costly intents were removed, costly failures rewritten, costly fetches rewritten with a new hash
    costly = lambda state: (c("cost_cents") > 30000) & (c("lifecycle") == state)
    damaged = sealed.where("NOT (cost_cents > 25000 AND lifecycle = 'INTENT')").withColumn(
        "payload", F.when(costly("FAILED") | costly("FETCHING"), "{}").otherwise(c("payload"))
    )
    damaged = damaged.withColumn("hash", F.when(costly("FETCHING"), L.record_hash("pos", fields, c("prev_hash"))).otherwise(c("hash")))
    return L.chain_validate(damaged, "pos", fields, ["day"])


CTES["transitions"] = (
    ("attempts",),
    """SELECT attempt, seq, before, lifecycle, CASE WHEN allowed THEN 'DISPOSITION_MISMATCH' ELSE 'INVALID_TRANSITION' END AS problem
       FROM (SELECT *, coalesce(before, '') || '>' || lifecycle IN ('>INTENT','INTENT>RESPONSE','INTENT>TERMINAL','RESPONSE>TERMINAL') AS allowed FROM (SELECT *, lag(lifecycle) OVER (PARTITION BY attempt ORDER BY seq) AS before FROM attempts))
       WHERE NOT allowed OR (lifecycle = 'TERMINAL' AND disposition IS DISTINCT FROM CASE WHEN before = 'INTENT' THEN 'PROVABLY_NOT_DISPATCHED' ELSE 'COMPLETED' END)""",
)


@query("lifecycle_transitions", ["transitions"], "SELECT * FROM transitions")
def _(t):
    return L.lifecycle_transitions(attempts(t), "attempt", "seq", ["owner"], disposition="disposition")


_REVIEW_STATES = [s for s in L.REVIEW if s] + ["COMPLETE"]
_REVIEW_PAIRS = ", ".join(f"'{a}>{b}'" for a, following in L.REVIEW.items() for b in following)


@query(
    "review_transitions",
    ["ledger"],
    f"""e AS (SELECT attempt_id, seq, ({_REVIEW_STATES!r})[1 + cost_cents % {len(_REVIEW_STATES)}] AS lifecycle FROM ledger),
       p AS (SELECT *, lag(lifecycle) OVER (PARTITION BY attempt_id ORDER BY seq) AS before FROM e)
       SELECT attempt_id, seq, before, lifecycle, 'INVALID_TRANSITION' AS problem FROM p WHERE before IS DISTINCT FROM lifecycle AND coalesce(before, '') || '>' || lifecycle NOT IN ({_REVIEW_PAIRS})""",
)
def _(t):
    # review states drawn from the cost of each event
    state = F.element_at(F.array(*[F.lit(s) for s in _REVIEW_STATES]), (c("cost_cents") % len(_REVIEW_STATES)).cast("int") + 1)
    events = t.ledger.select("attempt_id", "seq", state.alias("lifecycle"))
    return L.lifecycle_transitions(events, "attempt_id", "seq", table=L.REVIEW, may_repeat=True)


@query("lifecycle_transitions_stream", ["transitions"], "SELECT attempt, seq, before, lifecycle, problem FROM transitions")
def _(t):
    # the same check as a stateful stream over the event files
    folder = f"{ensure_checkpoint_dir(t.spark)}/transitions-{uuid.uuid4().hex}"
    schema = t.raw("events").schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    live = Tables(t.spark, t.dir)
    live.raw = lambda name: source  # the projection of a stream
    ledger_stream.run_transitions(attempts(live), "attempt", "seq", f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint")
    found = t.spark.read.parquet(f"{folder}/out").where(c("problem").isNotNull())
    return found.select("attempt", "seq", "before", "lifecycle", "problem")


@query("attempt_status_stream", ["attempts"], """SELECT attempt, count(*) AS events, max(seq) AS last_seq, arg_max(lifecycle, seq) AS last, bool_or(lifecycle = 'TERMINAL') AS terminal FROM attempts GROUP BY attempt""")
def _(t):
    folder = f"{ensure_checkpoint_dir(t.spark)}/status-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    live = Tables(t.spark, t.dir)
    live.raw = lambda name: source
    ledger_stream.run_status(attempts(live), "attempt", f"{folder}/out", f"{folder}/state")
    return ledger_stream.latest_status(t.spark.read.parquet(f"{folder}/out"), "attempt")


@query(
    "interrupted_to_uncertain",
    ["attempts"],
    "SELECT attempt, last, CASE WHEN last = 'FETCHING' THEN 'UNCERTAIN' ELSE last END AS status FROM (SELECT attempt, arg_max(lifecycle, seq) AS last FROM attempts GROUP BY attempt)",
)
def _(t):
    return L.interrupted_to_uncertain(attempts(t), "attempt", "seq")


@query(
    "running_budget",
    ["ledger"],
    """SELECT day, seq, spent, calls FROM (SELECT day, seq, cost_cents, CAST(sum(cost_cents) OVER w AS BIGINT) AS spent, row_number() OVER w AS calls FROM ledger WINDOW w AS (PARTITION BY day ORDER BY seq ROWS UNBOUNDED PRECEDING))
       WHERE spent - cost_cents + 4000 <= 60000 AND calls <= 25""",
)
def _(t):
    out = L.running_budget(t.ledger, ["day"], "seq", "cost_cents", 60000, 4000, 25)
    return out.select("day", "seq", "spent", "calls")


@query(
    "stopping_rule",
    ["adjudicated"],
    """SELECT ord AS stop_at, clean, defects, severe FROM (SELECT ord, CAST(count(*) FILTER (WHERE human_decision = 'APPROVE') OVER w AS BIGINT) AS clean, CAST(count(*) FILTER (WHERE human_decision = 'REVISE') OVER w AS BIGINT) AS defects, CAST(count(*) FILTER (WHERE severity = 'SEVERE') OVER w AS BIGINT) AS severe
       FROM adjudicated WINDOW w AS (ORDER BY ord ROWS UNBOUNDED PRECEDING)) WHERE clean >= 30 AND defects >= 30 AND severe >= 6 ORDER BY ord LIMIT 1""",
)
def _(t):
    rows = t.review.where(c("human_decision").isNotNull()).select("ord", "human_decision", "severity")
    counters = {"clean": c("human_decision") == "APPROVE", "defects": c("human_decision") == "REVISE", "severe": c("severity") == "SEVERE"}
    return L.stopping_position(rows, [], "ord", counters, {"clean": 30, "defects": 30, "severe": 6})


@query(
    "rebuild_session_state",
    ["attempts"],
    """r AS (SELECT attempt, count(*) AS events, count(*) FILTER (WHERE lifecycle = 'TERMINAL') AS terminal, CAST(sum(cost_cents) AS BIGINT) AS spent FROM attempts GROUP BY attempt),
       s AS (SELECT attempt, count(*) AS events, count(*) FILTER (WHERE lifecycle = 'TERMINAL') AS terminal, CAST(sum(cost_cents) AS BIGINT) AS spent FROM attempts WHERE cost_cents <= 15000 GROUP BY attempt)
       SELECT r.attempt, CASE WHEN s.attempt IS NULL THEN 'NOT_STORED' ELSE 'DIFFERENT' END AS status, concat_ws('|', CASE WHEN r.events IS DISTINCT FROM s.events THEN 'events' END, CASE WHEN r.terminal IS DISTINCT FROM s.terminal THEN 'terminal' END, CASE WHEN r.spent IS DISTINCT FROM s.spent THEN 'spent' END) AS fields
       FROM r LEFT JOIN s USING (attempt) WHERE s.attempt IS NULL OR r.events <> s.events OR r.terminal <> s.terminal OR r.spent <> s.spent""",
)
def _(t):
    # the stored ledger missed the costly events
    state = lambda df: df.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(c("lifecycle") == "TERMINAL").alias("terminal"), F.sum("cost_cents").alias("spent")
    )
    rows = attempts(t)
    return L.compare_state(state(rows), state(rows.where("cost_cents <= 15000")), "attempt", ["events", "terminal", "spent"])


KEY_SQL = """sha256('{' || CASE WHEN pace = 'fast' THEN '"config":"turbo",' ELSE '' END || '"schema":"v2","stage":"classify","title":"' || title || '","tmdb_id":' || tmdb_id || '}')"""


def _cache_key(title: Column) -> Column:
    identity = {"stage": F.lit("classify"), "schema": F.lit("v2"), "tmdb_id": c("tmdb_id"), "title": title}
    return L.content_cache_key(identity, F.when(c("pace") == "fast", "turbo"))


@query("content_cache_key", ["catalogue"], f"SELECT id, {KEY_SQL} AS cache_key FROM catalogue")
def _(t):
    return t.catalogue.select("id", _cache_key(c("title")).alias("cache_key"))


@query(
    "resume_plan",
    ["catalogue"],
    """SELECT id, CASE WHEN runtime_minutes = 100 THEN 'TERMINAL' WHEN emotional_weight = 'light' THEN 'FRESH' WHEN attention_demand = 'easy' THEN 'STALE' ELSE 'CACHE_HIT' END AS action FROM catalogue""",
)
def _(t):
    rows = t.catalogue
    candidates = rows.select("id", _cache_key(c("title")).alias("cache_key"), F.when(c("runtime_minutes") == 100, "COMPLETED").otherwise("PENDING").alias("state"))
    old_title = F.when(c("attention_demand") == "easy", F.concat("title", F.lit("!"))).otherwise(c("title"))
    cache = rows.where("emotional_weight <> 'light'").select("id", _cache_key(old_title).alias("cache_key"))
    return L.resume_plan(candidates, cache, "id")


@query(
    "escalate_tier",
    ["attempts"],
    """a AS (SELECT attempt, seq, CASE WHEN cost_cents < 2000 THEN 1 WHEN cost_cents < 6000 THEN 2 ELSE 3 END AS tier, CASE lifecycle WHEN 'FAILED' THEN 'PROVIDER_FAILURE' WHEN 'TERMINAL' THEN 'VALID' ELSE 'VALIDATION_FAILURE' END AS outcome FROM attempts),
       b AS (SELECT *, lag(tier) OVER w AS pt, lag(outcome) OVER w AS po FROM a WINDOW w AS (PARTITION BY attempt ORDER BY seq)),
       p AS (SELECT attempt, seq, ['low','high','max'][tier] AS tier, CASE WHEN pt IS NULL AND tier > 1 THEN 'FIRST_ATTEMPT_NOT_LOW' WHEN tier > pt + 1 THEN 'TIER_SKIPPED' WHEN tier > pt AND po <> 'VALIDATION_FAILURE' THEN 'ESCALATED_WITHOUT_VALIDATION_FAILURE' END AS problem FROM b)
       SELECT * FROM p WHERE problem IS NOT NULL""",
)
def _(t):
    kind, cost = c("lifecycle"), c("cost_cents")
    rows = attempts(t).select(
        "attempt", "seq", F.when(cost < 2000, "low").when(cost < 6000, "high").otherwise("max").alias("tier"),
        F.when(kind == "FAILED", "PROVIDER_FAILURE").when(kind == "TERMINAL", "VALID").otherwise("VALIDATION_FAILURE").alias("outcome"),
    )
    return L.escalation_problems(rows, "attempt", "seq")


@query(
    "block_rollup",
    ["ledger"],
    """b AS (SELECT (seq - 2) // 8 AS block, count(*) FILTER (WHERE cost_cents <= 40000) AS completed, sha256(string_agg(lifecycle || ':' || cost_cents, '|' ORDER BY seq)) AS digest FROM ledger WHERE seq >= 2 GROUP BY 1)
       SELECT block, completed, digest, completed = 8 AS complete, coalesce(block <= (SELECT min(block) FROM b WHERE completed <> 8), false) AS reachable FROM b""",
)
def _(t):
    return L.block_rollup(t.ledger, "seq", c("cost_cents") <= 40000, F.concat_ws(":", "lifecycle", c("cost_cents").cast("string")))


# --- decisions, packets, promotion --------------------------------------------


def packets(t: Tables) -> DataFrame:
    return t.review.select("candidate_id", "tmdb_id", c("ord").alias("blind_ordinal"), digest("candidate_id", "lang").alias("packet_hash"))


@query(
    "check_decisions",
    ["adjudicated"],
    """SELECT candidate_id, concat_ws('|', CASE WHEN source = 'src9' THEN 'MISSING_BLIND_RECORD' END, CASE WHEN source = 'src8' THEN 'ORDINAL_MISMATCH' END, CASE WHEN lang = 'es' AND source <> 'src9' THEN 'REVIEWED_ARTIFACT_HASH_DRIFT' END,
       CASE WHEN human_decision = 'APPROVE' AND lang = 'fr' THEN 'APPROVE_MUST_HAVE_SEVERITY_NONE' END, CASE WHEN human_decision = 'APPROVE' AND n_chars < 200 THEN 'APPROVE_CANNOT_HAVE_AFFECTED_FIELDS' END,
       CASE WHEN human_decision = 'REVISE' AND lang = 'de' THEN 'INVALID_AFFECTED_FIELD' END, CASE WHEN human_decision = 'REVISE' AND n_chars < 1000 THEN 'REVISE_REQUIRES_NON_EMPTY_REASON' END) AS failures FROM adjudicated""",
)
def _(t):
    rows = t.review.where(c("human_decision").isNotNull())
    approve = c("human_decision") == "APPROVE"
    none = F.array().cast("array<string>")
    decisions = rows.select(
        "candidate_id", "tmdb_id", "source",
        F.when(c("source") == "src8", c("ord") + 1).otherwise(c("ord")).alias("blind_ordinal"),
        F.when(c("lang") == "es", "old").otherwise(digest("candidate_id", "lang")).alias("reviewed_hash"),
        c("human_decision").alias("decision"),
        F.when(approve, F.when(c("lang") == "fr", "MINOR").otherwise("NONE")).otherwise(c("severity")).alias("severity"),
        F.when(approve, F.when(c("n_chars") < 200, F.array(F.lit("description"))).otherwise(none)).otherwise(F.when(c("lang") == "de", F.array(F.lit("title"))).otherwise(c("human_fields"))).alias("affected_fields"),
        F.when(approve | (c("n_chars") >= 1000), "because").otherwise(" ").alias("reason"),
    )
    blind = packets(t).join(t.review.where("source = 'src9'").select("candidate_id"), "candidate_id", "left_anti")
    blind = blind.select("candidate_id", *[c(n).alias(f"b_{n}") for n in ("tmdb_id", "blind_ordinal", "packet_hash")], c("candidate_id").alias("b_candidate_id"))
    return decisions.join(blind, "candidate_id", "left").select("candidate_id", joined(rules.decision_rules()).alias("failures"))


@query(
    "check_blind_packets",
    ["review"],
    """SELECT source, candidate_id, 'ORDINAL_MISMATCH' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS pos FROM review) WHERE lang = 'fr'
       UNION ALL SELECT source, 'd' || (ord - ord % 50), 'DUPLICATE_CANDIDATE_ID' FROM review WHERE n_chars < 200 GROUP BY source, ord - ord % 50 HAVING count(*) > 1""",
)
def _(t):
    rows = t.review.select("source", "candidate_id", "ord", "lang", "n_chars")
    placed = ranked(rows, ["source"], [c("ord").asc()], [(integer_bucket("ord"), True)], out="position")
    stated = placed.withColumn("blind_ordinal", F.when(c("lang") == "fr", c("position") + 1).otherwise(c("position")))
    off = stated.where(c("blind_ordinal") != c("position")).select("source", "candidate_id", F.lit("ORDINAL_MISMATCH").alias("problem"))
    merged = rows.where("n_chars < 200").select("source", F.concat(F.lit("d"), (c("ord") - c("ord") % 50).cast("string")).alias("candidate_id"))
    twice = merged.groupBy("source", "candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return off.unionByName(twice.select("source", "candidate_id", F.lit("DUPLICATE_CANDIDATE_ID").alias("problem")))


PRODUCTION_FIELDS = ["id", "moods", "palette", "title", "tmdbId"]


@query(
    "check_production_row",
    ["review"],
    """SELECT candidate_id, concat_ws('|', CASE WHEN lang = 'de' THEN 'UNKNOWN_FIELD:reviewer' END, CASE WHEN lang = 'es' THEN 'MISSING_FIELD:palette' END, CASE WHEN source = 'src6' THEN 'STALE_HASH:facts' END, CASE WHEN severity = 'SEVERE' THEN 'IDENTITY_MISMATCH' END) AS failures FROM review""",
)
def _(t):
    lang = c("lang")
    fields = F.when(lang == "de", F.array(*[F.lit(f) for f in [*PRODUCTION_FIELDS, "reviewer"]])).when(
        lang == "es", F.array(*[F.lit(f) for f in PRODUCTION_FIELDS if f != "palette"])
    ).otherwise(F.array(*[F.lit(f) for f in PRODUCTION_FIELDS]))
    record = F.to_json(F.map_from_entries(F.transform(fields, lambda f: F.named_struct(F.lit("key"), f, F.lit("value"), F.lit("v")))))
    recorded = {h: F.sha2(F.concat(F.lit(h), "candidate_id", F.when(F.lit(h == "facts") & (c("source") == "src6"), "-old").otherwise("")), 256) for h in HASHES}
    actual = {h: F.sha2(F.concat(F.lit(h), "candidate_id"), 256) for h in HASHES}
    rows = t.review.select(
        "candidate_id", "tmdb_id", record.alias("record"), F.struct(*[v.alias(h) for h, v in recorded.items()]).alias("recorded"),
        F.struct(*[v.alias(h) for h, v in actual.items()]).alias("actual"),
        F.when(c("severity") == "SEVERE", c("tmdb_id") + 1).otherwise(c("tmdb_id")).alias("artifact_tmdb"),
    )
    return rows.select("candidate_id", joined(rules.production_row_failures(PRODUCTION_FIELDS, HASHES)).alias("failures"))


@query(
    "check_promotion_manifest",
    ["review"],
    """t AS (SELECT source, count(*) AS n, sha256(string_agg(candidate_id, '|' ORDER BY candidate_id)) AS roster FROM review WHERE human_decision = 'APPROVE' GROUP BY source),
       m AS (SELECT source, count(*) AS n, sha256(string_agg(candidate_id, '|' ORDER BY candidate_id)) AS roster FROM review WHERE human_decision = 'APPROVE' AND lang <> 'es' GROUP BY source)
       SELECT t.source, concat_ws('|', CASE WHEN m.n IS DISTINCT FROM t.n THEN 'COUNT_MISMATCH' END, CASE WHEN m.roster IS DISTINCT FROM t.roster THEN 'ROSTER_MISMATCH' END) AS failures FROM t LEFT JOIN m USING (source)""",
)
def _(t):
    accepted = t.review.where("human_decision = 'APPROVE'").select("source", "candidate_id", "lang")
    # the manifest lists the accepted rows of all languages but one
    return rules.check_manifest(accepted.where("lang <> 'es'").drop("lang"), accepted.drop("lang"), "source")
