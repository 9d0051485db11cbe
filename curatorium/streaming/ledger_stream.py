"""Structured Streaming versions of the ledger checks.

Events arrive in files.  The transition check runs per trigger with the same
bucketed previous-row join as the batch check, starting from a table of the last
event per attempt, so one attempt may hold a large part of a trigger.  An event
at or below the last sequence of an earlier trigger is reported as LATE and does
not change the state.  Every trigger writes folders named after its number and
reads those of the trigger before, so a replayed trigger gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.spread import integer_bucket, previous
from curatorium.operators.ledger import fits_disposition, is_allowed


def check_trigger(batch: DataFrame, prior: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(checked events, last event per attempt) of one trigger.  Sequence numbers are unique per attempt.

    Only the attempts of the batch meet its events; the others are handed on as they are.
    """
    events = batch.select(key, seq, "lifecycle", "disposition")
    keys = events.select(key).distinct()
    untouched = prior.select(key, seq, "lifecycle").join(keys, key, "left_anti")
    prior = prior.join(keys, key, "left_semi")
    known = events.join(prior.select(key, F.col(seq).alias("__last"), F.col("lifecycle").alias("__state")), key, "left")
    is_late = F.coalesce(F.col(seq) <= F.col("__last"), F.lit(False))
    late = known.where(is_late).select(key, seq, F.col("__state").alias("before"), "lifecycle", F.lit("LATE").alias("problem"))
    fresh = known.where(~is_late).select(key, seq, "lifecycle", "disposition")
    carried = prior.select(key, seq, "lifecycle", F.lit(None).cast("string").alias("disposition"), F.lit(True).alias("__carried"))
    chain = fresh.withColumn("__carried", F.lit(False)).unionByName(carried)
    linked = previous(chain, [key], seq, integer_bucket(seq), {"before": "lifecycle"}).where(~F.col("__carried"))
    problem = F.when(~is_allowed(F.col("before"), F.col("lifecycle")), "INVALID_TRANSITION").when(
        ~fits_disposition(F.col("before"), F.col("lifecycle"), F.col("disposition")), "DISPOSITION_MISMATCH"
    )
    checked = linked.select(key, seq, "before", "lifecycle", problem.alias("problem")).unionByName(late)
    last = fresh.select(key, seq, "lifecycle").unionByName(prior.select(key, seq, "lifecycle")).groupBy(key).agg(F.max_by(F.struct(seq, "lifecycle"), seq).alias("s"))
    return checked, last.select(key, "s.*").unionByName(untouched)


def _exists(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, target, fs.exists(target)


def run_transitions(events: DataFrame, key: str, seq: str, out: str, state: str, checkpoint: str) -> None:
    """Check all available events; results go to ``out/epoch=N``, the last events to ``state/epoch=N``."""
    fields = f"{key} string, {seq} bigint, lifecycle string"

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _, _, there = _exists(spark, f"{state}/epoch={epoch - 1}")
        if epoch and not there:
            raise FileNotFoundError(f"the state of trigger {epoch - 1} is gone from {state}; an empty one would pass wrong events")
        prior = spark.read.schema(fields).parquet(f"{state}/epoch={epoch - 1}") if epoch else spark.createDataFrame([], fields)
        checked, last = check_trigger(batch, prior, key, seq)
        checked.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        last.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        fs, old, stale = _exists(spark, f"{state}/epoch={epoch - 2}")
        if stale:
            fs.delete(old, True)

    keyed = events.withColumn(key, F.col(key).cast("string"))
    _run(keyed.writeStream.foreachBatch(step).outputMode("append"), checkpoint)


def status_counts(events: DataFrame, key: str) -> DataFrame:
    """Running status per attempt, for update mode."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.max("seq").alias("last_seq"),
        F.max_by("lifecycle", "seq").alias("last"),
        F.bool_or(F.col("lifecycle") == "TERMINAL").alias("terminal"),
    )


def run_status(events: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Write each trigger's updated statuses to a folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(status_counts(events, key).writeStream.foreachBatch(write).outputMode("update"), checkpoint)


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_status(updates: DataFrame, key: str) -> DataFrame:
    """The newest update of every attempt."""
    fields = [c for c in updates.columns if c not in (key, "epoch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*fields), "epoch").alias("u")).select(key, "u.*")
