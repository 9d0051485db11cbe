"""Replay of append-only ledgers: status, chain, transitions, budgets, resume and blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import digest
from curatorium.functions.spread import integer_bucket, previous, running_sums

GENESIS = "0" * 64


def attempt_status(planned: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Durable status of every planned attempt from the kinds of events it has."""
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    terminal = F.col("lifecycle") == "TERMINAL"
    flags = events.groupBy(key).agg(
        has(terminal & (F.col("disposition") == "PROVABLY_NOT_DISPATCHED")).alias("undispatched"),
        has(terminal).alias("terminal"),
        has(F.col("lifecycle") == "RESPONSE").alias("response"),
    )
    status = (
        F.when(F.col("terminal").isNull(), "NO_DURABLE_ATTEMPT")
        .when(F.col("undispatched"), "PROVABLY_NOT_DISPATCHED")
        .when(F.col("terminal"), "COMPLETED")
        .when(F.col("response"), "DURABLE_RESPONSE")
        .otherwise("UNKNOWN_IN_FLIGHT")
    )
    return planned.select(key).distinct().join(flags, key, "left").select(key, status.alias("status"))


def record_hash(seq: str, fields: Sequence[str], before: Column) -> Column:
    """Hash of a record's content together with the hash of the record before it."""
    return F.sha2(F.concat(before, F.lit(":"), digest(seq, *fields)), 256)


def seal(records: DataFrame, seq: str, fields: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Add prev_hash and hash to every record of the ledgers ``parts``.

    A hash needs the one before it, so a ledger is sealed in order: its rows stream through one task, which holds one hash.
    Different ledgers are sealed side by side.  Checking (``chain_validate``) needs no such order.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in records.dtypes)
    names = records.columns

    def run(batches):
        import hashlib

        import pyarrow as pa

        ledger, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            keys = zip(*[batch.column(p).to_pylist() for p in parts]) if parts else ((),) * batch.num_rows
            for key, content in zip(keys, batch.column("__content").to_pylist()):
                if key != ledger:
                    ledger, last = key, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}:{content}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(before, pa.string()), pa.array(own, pa.string())], [*names, "prev_hash", "hash"])

    rows = records.withColumn("__content", digest(seq, *fields))
    rows = (rows.repartition(*parts) if parts else rows.coalesce(1)).sortWithinPartitions(*parts, seq)
    return rows.mapInArrow(run, f"{kinds}, prev_hash string, hash string")


def chain_validate(records: DataFrame, seq: str, fields: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """One row per broken record: sequence gap, broken link, or content and link that don't match the record's hash."""
    before = previous(records, parts, seq, integer_bucket(seq), {"__hash": "hash", "__seq": seq})
    expected = F.coalesce(F.col("__seq") + 1, F.lit(0))
    problem = (
        F.when(F.col(seq) != expected, "SEQUENCE_GAP")
        .when(F.col("prev_hash") != F.coalesce("__hash", F.lit(GENESIS)), "BROKEN_LINK")
        .when(record_hash(seq, fields, F.col("prev_hash")) != F.col("hash"), "HASH_MISMATCH")
    )
    return before.select(*parts, seq, problem.alias("problem")).where(F.col("problem").isNotNull())


# Fixed tables: what may follow each state; '' is the start of an attempt.
WRITE_AHEAD = {"": ["INTENT"], "INTENT": ["RESPONSE", "TERMINAL"], "RESPONSE": ["TERMINAL"]}
REVIEW = {
    "": ["PENDING"],
    "PENDING": ["PACKET_FROZEN"],
    "PACKET_FROZEN": ["GEMINI_PENDING", "CLAUDE_PENDING", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "GEMINI_PENDING": ["GEMINI_VALID", "GEMINI_INVALID", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "GEMINI_INVALID": ["GEMINI_PENDING", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "GEMINI_VALID": ["CLAUDE_PENDING", "READY_FOR_HUMAN_ADJUDICATION", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "CLAUDE_PENDING": ["CLAUDE_VALID", "CLAUDE_INVALID", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "CLAUDE_INVALID": ["CLAUDE_PENDING", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "CLAUDE_VALID": ["GEMINI_PENDING", "READY_FOR_HUMAN_ADJUDICATION", "REVIEW_PAUSED_PENDING_ADVISORY"],
    "REVIEW_PAUSED_PENDING_ADVISORY": ["PACKET_FROZEN", "GEMINI_PENDING", "CLAUDE_PENDING", "READY_FOR_HUMAN_ADJUDICATION"],
    "READY_FOR_HUMAN_ADJUDICATION": ["HUMAN_ADJUDICATION_PENDING", "HUMAN_ADJUDICATED"],
    "HUMAN_ADJUDICATION_PENDING": ["HUMAN_ADJUDICATED", "READY_FOR_HUMAN_ADJUDICATION"],
    "HUMAN_ADJUDICATED": ["QA_PENDING", "COMPLETE"],
    "QA_PENDING": ["COMPLETE"],
}


def is_allowed(before: Column, state: Column, table: dict[str, list[str]] = WRITE_AHEAD, may_repeat: bool = False) -> Column:
    """Whether ``state`` may follow ``before`` (null: nothing) by a transition table."""
    pairs = {(a, b) for a, following in table.items() for b in following}
    if may_repeat:
        known = {state for a, following in table.items() for state in (a, *following)} - {""}
        pairs |= {(s, s) for s in known}
    listed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(pairs)])
    return F.coalesce(F.array_contains(listed, F.concat(F.coalesce(before, F.lit("")), F.lit(">"), state)), F.lit(False))


def fits_disposition(before: Column, state: Column, disposition: Column) -> Column:
    """A terminal record says whether its request ever left: only after INTENT alone it provably did not."""
    expected = F.when(before == "INTENT", "PROVABLY_NOT_DISPATCHED").otherwise("COMPLETED")
    return (state != "TERMINAL") | disposition.eqNullSafe(expected)


def lifecycle_transitions(
    events: DataFrame,
    key: str,
    seq: str,
    identity: Sequence[str] = (),
    table: dict[str, list[str]] = WRITE_AHEAD,
    may_repeat: bool = False,
    disposition: str | None = None,
) -> DataFrame:
    """Events that change the identity of their attempt, don't follow from the one before, or end with the wrong disposition."""
    carried = {"before": "lifecycle", **{f"__{c}": c for c in identity}}
    rows = previous(events, [key], seq, integer_bucket(seq), carried)
    changed = F.lit(False)
    for c in identity:
        changed = changed | (F.col("before").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    problem = F.when(changed, "IDENTITY_CHANGED").when(~is_allowed(F.col("before"), F.col("lifecycle"), table, may_repeat), "INVALID_TRANSITION")
    if disposition:
        problem = problem.when(~fits_disposition(F.col("before"), F.col("lifecycle"), F.col(disposition)), "DISPOSITION_MISMATCH")
    return rows.select(key, seq, "before", "lifecycle", problem.alias("problem")).where(F.col("problem").isNotNull())


def interrupted_to_uncertain(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Last state per key; one that was fetching when the run stopped is uncertain and never retried."""
    last = events.groupBy(key).agg(F.max_by("lifecycle", seq).alias("last"))
    return last.withColumn("status", F.when(F.col("last") == "FETCHING", "UNCERTAIN").otherwise(F.col("last")))


def running_budget(events: DataFrame, run: Sequence[str], seq: str, cost: str, ceiling: int, estimate: int, max_calls: int) -> DataFrame:
    """Rows a run can afford: cost so far plus the estimate stays within the ceiling and calls within the cap.

    Both totals only grow, so the rows before the stop are exactly those that pass.
    """
    rows = running_sums(
        events, run, [F.col(seq).asc()], [(integer_bucket(seq), True)], {"spent": F.col(cost), "calls": F.lit(1)}
    )
    return rows.where((F.col("spent") - F.col(cost) + estimate <= ceiling) & (F.col("calls") <= max_calls))


def stopping_position(rows: DataFrame, parts: Sequence[str], order: str, counters: dict[str, Column], targets: dict[str, int]) -> DataFrame:
    """First position where every running count has reached its target, with the counts there."""
    sums = {n: F.coalesce(c, F.lit(False)).cast("bigint") for n, c in counters.items()}
    counted = running_sums(rows, parts, [F.col(order).asc()], [(integer_bucket(order), True)], sums)
    done = F.lit(True)
    for name, target in targets.items():
        done = done & (F.col(name) >= target)
    return counted.where(done).groupBy(*parts).agg(
        F.min(order).alias("stop_at"), *[F.min_by(n, order).alias(n) for n in counters]
    ).where(F.col("stop_at").isNotNull())


def compare_state(rebuilt: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys whose rebuilt counters differ from the stored ones, or exist on one side only."""
    a = rebuilt.select(key, F.struct(*fields).alias("rebuilt"))
    b = stored.select(key, F.struct(*fields).alias("stored"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("stored").isNull(), "NOT_STORED").when(F.col("rebuilt").isNull(), "NOT_REBUILT").when(
        F.col("rebuilt") != F.col("stored"), "DIFFERENT"
    )
    off = F.array_compact(F.array(*[F.when(~F.col(f"rebuilt.{f}").eqNullSafe(F.col(f"stored.{f}")), F.lit(f)) for f in fields]))
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(key, "status", F.array_join(off, "|").alias("fields"))


def content_cache_key(identity: dict[str, Column], config: Column) -> Column:
    """Digest of the inputs that decide a result; an absent configuration is left out of the preimage."""
    names = sorted([*identity, "config"])
    full = F.struct(*[(config if n == "config" else identity[n]).alias(n) for n in names])
    bare = F.struct(*[identity[n].alias(n) for n in sorted(identity)])
    keep = {"ignoreNullFields": "false"}
    return F.sha2(F.when(config.isNull(), F.to_json(bare, keep)).otherwise(F.to_json(full, keep)), 256)


def resume_plan(candidates: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What a resumed run does per candidate: skip terminal ones, use or refresh the cache, or start fresh."""
    held = cache.select(key, F.col("cache_key").alias("cached_key"))
    wide = candidates.join(held, key, "left")
    action = (
        F.when(F.col("state").isin("COMPLETED", "TERMINAL_FAILURE"), "TERMINAL")
        .when(F.col("cached_key").isNull(), "FRESH")
        .when(F.col("cached_key") == F.col("cache_key"), "CACHE_HIT")
        .otherwise("STALE")
    )
    return wide.select(key, action.alias("action"))


TIERS = ["low", "high", "max"]


def escalation_problems(attempts: DataFrame, key: str, seq: str) -> DataFrame:
    """Attempts that raise the tier without a completed validation failure just below it."""
    rows = previous(attempts, [key], seq, integer_bucket(seq), {"__tier": "tier", "__outcome": "outcome"})
    rank = lambda c: F.array_position(F.array(*[F.lit(t) for t in TIERS]), c)
    now, before = rank(F.col("tier")), F.coalesce(rank(F.col("__tier")), F.lit(0))
    problem = (
        F.when(F.col("__tier").isNull() & (now > 1), "FIRST_ATTEMPT_NOT_LOW")
        .when(F.col("__tier").isNotNull() & (now > before + 1), "TIER_SKIPPED")
        .when(F.col("__tier").isNotNull() & (now > before) & (F.col("__outcome") != "VALIDATION_FAILURE"), "ESCALATED_WITHOUT_VALIDATION_FAILURE")
    )
    return rows.select(key, seq, "tier", problem.alias("problem")).where(F.col("problem").isNotNull())


def block_rollup(rows: DataFrame, seq: str, complete: Column, content: Column, size: int = 8, first: int = 2) -> DataFrame:
    """Counts and digest per fixed block of positions, and whether all earlier blocks are complete.

    Rows of one position are merged first, so a block lists at most ``size`` of them: a repeated position enters the digest
    with its smallest content and its number of rows, and counts once, as complete if all its rows are.
    """
    per_seq = rows.where(F.col(seq) >= first).groupBy(F.col(seq).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(content).alias("c"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("ok"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("s", "n", "c"))), lambda x: F.when(x["n"] == 1, x["c"]).otherwise(F.concat_ws("#", x["c"], x["n"].cast("string"))))
    blocks = (
        per_seq.groupBy(F.floor((F.col("s") - first) / size).cast("bigint").alias("block"))
        .agg(F.count_if("ok").alias("completed"), F.sha2(F.array_join(text, "|"), 256).alias("digest"))
        .withColumn("complete", F.col("completed") == size)
    )
    first_open = blocks.where(~F.col("complete")).agg(F.min("block").alias("first_open"))
    return blocks.join(F.broadcast(first_open), F.col("block") <= F.coalesce("first_open", F.col("block")), "left").select(
        "block", "completed", "digest", "complete", F.col("first_open").isNotNull().alias("reachable")
    )
