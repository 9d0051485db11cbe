"""Ledger attempts in event time: a state machine per attempt with timers, and windows behind a watermark.

Events carry the time they happened (``ts``) and the time they reached the ledger (``arrived``).  The watermark runs on the
arrival time, which only grows, so Spark itself drops nothing: an event that happened before the watermark of its trigger is
reported as LATE and leaves the state alone.  Every other event is folded into the state of its attempt, which holds six
numbers.  A timer at the last event time plus ``timeout`` closes the attempt: one row with its status is written and the
state is dropped, so the state holds the attempts of the last ``delay`` + ``timeout`` of event time and no more.

Statuses are those of ``ledger.attempt_status``; an attempt that ends without a terminal record is reported with what it
durably has, DURABLE_RESPONSE or UNKNOWN_IN_FLIGHT, and is never retried.

One attempt may hold a large part of a trigger: the state is kept per attempt and shard, a hash of the sequence number, and
``closed_attempts`` adds the shards up.  Results don't depend on the shards or on the order of events inside a trigger.

Most attempts have a few events per trigger, so a call per attempt would cost more than its events.  Attempts and shards are
dealt over ``buckets``, hashes of both: a bucket folds its events at once, keeps the six numbers of every open pair as one
Arrow table and has one timer, for the pair that is due first.  A bucket holds its share of the open pairs; take more buckets
where that is too much for one value.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 8
BUCKETS = 1024
PAIR = ["attempt", "shard"]
STATE = "due long, pairs binary"
OUTPUT = "attempt string, shard int, kind string, seq long, events long, first_ms long, last_ms long, undispatched boolean, terminal boolean, response boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class AttemptTimers(StatefulProcessor):
    """Folds events into the states of the (attempt, shard) pairs of a bucket and closes a pair when its time has passed."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pairs", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        due, pairs = self._held()
        for frame in rows:
            is_late = frame["ts_ms"] < mark
            late, fresh = frame[is_late], frame[~is_late]
            if len(late):
                yield pd.DataFrame({"attempt": late["attempt"], "shard": late["shard"], "kind": "LATE", "seq": late["seq"], "events": None, "first_ms": late["ts_ms"], "last_ms": late["ts_ms"], "undispatched": None, "terminal": None, "response": None})
            if len(fresh):
                ends = fresh["lifecycle"] == "TERMINAL"
                seen = {"undispatched": ends & (fresh["disposition"] == "PROVABLY_NOT_DISPATCHED"), "terminal": ends, "response": fresh["lifecycle"] == "RESPONSE"}
                pairs = _folded(pairs, pd.DataFrame({**{k: fresh[k] for k in PAIR}, "events": 1, "first_ms": fresh["ts_ms"], "last_ms": fresh["ts_ms"], **seen}))
        self._keep(pairs, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        _, pairs = self._held()
        expiry = pairs["last_ms"] + self.timeout_ms
        over = (expiry < timerValues.getCurrentWatermarkInMs()) | (expiry <= expiredTimerInfo.getExpiryTimeInMs())
        self._keep(pairs[~over], None)  # the timer that has fired is gone
        closed = pairs[over]
        yield pd.DataFrame({**{k: closed[k] for k in PAIR}, "kind": "CLOSED", "seq": None, **{k: closed[k] for k in closed.columns if k not in PAIR}})

    def close(self) -> None:
        pass

    def _held(self):
        """Time of the timer and table of the open pairs, both None if there are none."""
        import pyarrow as pa

        held = self.state.get() if self.state.exists() else None
        return (held[0], pa.ipc.open_stream(bytes(held[1])).read_pandas()) if held else (None, None)

    def _keep(self, pairs, due: int | None) -> None:
        """Store the open pairs and set the timer for the first one that is due; ``due`` is the timer that is set."""
        import pyarrow as pa

        if pairs is None:
            return
        first = pairs["last_ms"].min()
        wanted = int(first) + self.timeout_ms if first == first else None
        if wanted != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if len(pairs):
            table, sink = pa.Table.from_pandas(pairs, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.state.update((wanted, sink.getvalue().to_pybytes()))
        else:
            self.state.clear()


def _folded(pairs, more):
    """One row per pair of both tables."""
    import pandas as pd

    rows = more if pairs is None else pd.concat([pairs, more], ignore_index=True)
    how = {"events": "sum", "first_ms": "min", "last_ms": "max", **dict.fromkeys(("undispatched", "terminal", "response"), "max")}
    return rows.groupby(PAIR, dropna=False, sort=False, as_index=False).agg(how)


def timed_attempts(events: DataFrame, delay: str, timeout_ms: int, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """The stream of LATE events and CLOSED attempt shards of (attempt, seq, ts, arrived, lifecycle, disposition)."""
    keyed = events.withWatermark("arrived", delay).select(
        F.col("attempt").cast("string").alias("attempt"), F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"),
        F.col("seq").cast("long").alias("seq"), F.unix_millis("ts").alias("ts_ms"), "lifecycle", "disposition", "arrived",
    )
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("attempt", "shard"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(AttemptTimers(timeout_ms), OUTPUT, "Append", "EventTime")


def run_timed_attempts(events: DataFrame, delay: str, timeout_ms: int, out: str, checkpoint: str, shards: int = SHARDS, buckets: int = BUCKETS) -> int:
    """Process all available events; each trigger writes its rows to a folder of its own below ``out``.

    A trigger that is repeated after a failure overwrites its folder.  Returns the rows of state that are left.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    done = _finish(events.sparkSession, timed_attempts(events, delay, timeout_ms, shards, buckets).writeStream.foreachBatch(write).outputMode("append"), checkpoint)
    return done["stateOperators"][0]["numRowsTotal"] if done and done["stateOperators"] else 0


def _finish(spark, writer, checkpoint: str):
    """Run to the end of the input with the state store that keeps timers; the last progress."""
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, held)
    running.awaitTermination()
    return running.lastProgress


def status_of(undispatched: Column, terminal: Column, response: Column) -> Column:
    return F.when(undispatched, "PROVABLY_NOT_DISPATCHED").when(terminal, "COMPLETED").when(response, "DURABLE_RESPONSE").otherwise("UNKNOWN_IN_FLIGHT")


def closed_attempts(found: DataFrame) -> DataFrame:
    """(attempt, events, first_ms, last_ms, status) of the written rows: shards added up."""
    merged = found.where("kind = 'CLOSED'").groupBy("attempt").agg(
        F.sum("events").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        *[F.bool_or(flag).alias(flag) for flag in ("undispatched", "terminal", "response")],
    )
    return merged.select("attempt", "events", "first_ms", "last_ms", status_of(F.col("undispatched"), F.col("terminal"), F.col("response")).alias("status"))


def late_events(found: DataFrame) -> DataFrame:
    return found.where("kind = 'LATE'").select("attempt", "seq", F.col("first_ms").alias("ts_ms"))


# --- windows ---------------------------------------------------------------------


def window_totals(events: DataFrame, length: str, slide: str | None, keys: list[str], delay: str) -> DataFrame:
    """Events and cost per tumbling (no ``slide``) or sliding window of event time, written once the watermark passes its end."""
    timed = events.withWatermark("ts", delay)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    totals = timed.groupBy(span.alias("span"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("cost_cents").alias("cost_cents"))
    return totals.select(F.col("span.start").alias("starts"), F.col("span.end").alias("ends"), *keys, "events", "cost_cents")


def session_totals(events: DataFrame, gap: str, keys: list[str], delay: str) -> DataFrame:
    """Events and cost per session, a run of events of a key with gaps under ``gap``, written once it can't grow any more."""
    timed = events.withWatermark("ts", delay)
    totals = timed.groupBy(F.session_window("ts", gap).alias("span"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("cost_cents").alias("cost_cents"))
    return totals.select(F.col("span.start").alias("starts"), F.col("span.end").alias("ends"), *keys, "events", "cost_cents")


def run_windows(totals: DataFrame, out: str, checkpoint: str) -> None:
    """Append the windows that close to ``out``."""
    _finish(totals.sparkSession, totals.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


# --- streams against streams -------------------------------------------------------


def answered(asked: DataFrame, answers: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """Every question (key, seq, ts) with the answers of its key that follow ``within`` the interval, or none.

    Both sides are kept only as long as the watermark allows a match; a question without an answer is written once no answer
    can come any more.  Result: key, seq, ts, answer_seq, answer_ts.
    """
    left = asked.select(key, "seq", "ts").withWatermark("ts", delay)
    right = answers.select(F.col(key).alias("__key"), F.col("seq").alias("answer_seq"), F.col("ts").alias("answer_ts")).withWatermark("answer_ts", delay)
    follows = (F.col(key) == F.col("__key")) & (F.col("answer_ts") >= F.col("ts")) & (F.col("answer_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return left.join(right, follows, "left_outer").drop("__key")


def once(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Events without the repetitions that arrive within ``delay`` of the first; the state holds the keys of that time only."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
