"""Event-time attempts: timers, late events, shards and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curatorium.streaming import attempt_stream as S

HOUR = 3_600_000
START = dt.datetime(2024, 3, 1)
SCHEMA = "attempt string, seq long, ts timestamp, arrived timestamp, lifecycle string, disposition string"


def _event(attempt, seq, hour, lifecycle, arrived=None, disposition=None):
    return attempt, seq, START + dt.timedelta(hours=hour), START + dt.timedelta(hours=hour if arrived is None else arrived), lifecycle, disposition


WAVES = [
    # a ends with an answer; b never goes out; c is left with a response; d with an intent only; hot has many events
    [_event("a", 0, 1, "INTENT"), _event("a", 1, 2, "RESPONSE"), _event("b", 2, 1, "INTENT"), _event("b", 3, 3, "TERMINAL", disposition="PROVABLY_NOT_DISPATCHED"), _event("c", 4, 2, "INTENT"), _event("d", 5, 2, "INTENT")]
    + [_event("hot", 100 + i, 1 + i / 100, "INTENT" if i == 0 else "FETCHING") for i in range(300)],
    # a ends on time, c gets its response; x arrives with an event older than the watermark
    [_event("a", 6, 9, "TERMINAL", disposition="COMPLETED"), _event("c", 7, 8, "RESPONSE", arrived=11), _event("d", 8, 0, "RESPONSE", arrived=12), _event("x", 9, -3, "INTENT", arrived=12), _event("y", 10, 12, "INTENT")],
    # an event of a, long after its attempt was closed; a new attempt stays open
    [_event("a", 11, 5, "RESPONSE", arrived=80), _event("z", 12, 80, "INTENT")],
    [_event("z", 13, 81, "TERMINAL", arrived=81, disposition="PROVABLY_NOT_DISPATCHED")],
]


def _run(spark, folder, shards):
    left = []
    for wave in WAVES:
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        left.append(S.run_timed_attempts(stream, "2 hours", 24 * HOUR, f"{folder}/out", f"{folder}/checkpoint", shards))
    found = spark.read.schema(S.OUTPUT).parquet(f"{folder}/out")
    ms = lambda column: (column - F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))) / HOUR
    closed = {tuple(r) for r in S.closed_attempts(found).select("attempt", "events", ms(F.col("first_ms")), ms(F.col("last_ms")), "status").collect()}
    late = {tuple(r) for r in S.late_events(found).select("attempt", "seq").collect()}
    return closed, late, left


@pytest.mark.parametrize("shards", [1, 4])
def test_attempts_close_by_timer_and_late_events_are_reported(spark, tmp_path, shards):
    closed, late, left = _run(spark, str(tmp_path), shards)
    assert late == {("d", 8), ("x", 9), ("a", 11)}
    assert closed == {
        ("a", 3, 1.0, 9.0, "COMPLETED"), ("b", 2, 1.0, 3.0, "PROVABLY_NOT_DISPATCHED"), ("c", 2, 2.0, 8.0, "DURABLE_RESPONSE"), ("d", 1, 2.0, 2.0, "UNKNOWN_IN_FLIGHT"),
        ("hot", 300, 1.0, 3.99, "UNKNOWN_IN_FLIGHT"), ("y", 1, 12.0, 12.0, "UNKNOWN_IN_FLIGHT"),
    }
    # after the third wave only z is open, whatever came before: its state and its timer
    assert left[-1] < 12 * shards and left[2] < 12


def test_empty_input_leaves_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert S.run_timed_attempts(stream, "2 hours", HOUR, f"{tmp_path}/out", f"{tmp_path}/checkpoint") == 0


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    closed, late, _ = _run(spark, str(tmp_path), 2)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    S.run_timed_attempts(stream, "2 hours", 24 * HOUR, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 2)
    found = spark.read.schema(S.OUTPUT).parquet(f"{tmp_path}/out")
    assert S.closed_attempts(found).count() == len(closed) and S.late_events(found).count() == len(late)


def test_calls_grow_with_buckets_not_with_attempts(spark, tmp_path):
    """Many attempts of one event each: a bucket keeps them all in one row of state under one timer."""
    rows = [(f"a{i}", i, START + dt.timedelta(minutes=i % 60), START + dt.timedelta(minutes=i % 60), "INTENT", None) for i in range(3000)]
    for wave, part in enumerate((rows, [_event("end", 9000, 60, "INTENT")])):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        left = S.run_timed_attempts(stream, "2 hours", 24 * HOUR, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 1)
        assert left <= (3 * S.BUCKETS if wave == 0 else 3)
    closed = S.closed_attempts(spark.read.schema(S.OUTPUT).parquet(f"{tmp_path}/out"))
    assert {tuple(r) for r in closed.select("attempt", "events", "status").collect()} == {(f"a{i}", 1, "UNKNOWN_IN_FLIGHT") for i in range(3000)}
