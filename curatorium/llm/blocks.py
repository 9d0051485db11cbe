"""Buckets of any size cut into pairs of blocks that one task can hold, without rows per pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def pairs_within(first: np.ndarray, rows: int, limit: int):
    """Index pairs p < q inside runs that start at ``first``, about ``limit`` at a time (one row's pairs at least)."""
    ends = np.repeat(np.append(first[1:], rows), np.diff(np.append(first, rows)))
    counts = ends - np.arange(rows) - 1
    upto = np.cumsum(counts)
    at = 0
    while at < rows:
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + limit, side="right")))
        c = counts[at:stop]
        p = np.repeat(np.arange(at, stop), c)
        q = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + p + 1
        yield p, q
        at = stop


def _parts(rows: Column, weight: Column, most_rows: int, most_weight: int) -> Column:
    return F.greatest(F.ceil(rows / most_rows), F.ceil(weight / most_weight), F.lit(1)).cast("int")


def meeting_blocks(members: DataFrame, labels: DataFrame, most_rows: int, most_weight: int) -> DataFrame:
    """Rows of the buckets that hold two labels, once for every pair of blocks they belong to.

    ``members`` are rows (key, tag, node, weight), ``labels`` (nid, label); a node without a label is its own.  Blocks hold
    about ``most_rows`` rows and ``most_weight`` of weight.  The rows of a bucket's most frequent label need no look at each
    other: their blocks only meet those of the other rows, so a hot bucket with few strangers is listed about once, not once
    per block.  Result: node, weight, label, tag, block, side, alone; a block that meets itself is ``alone`` and lists each
    row once, of two blocks one is side 0.
    """
    labelled = members.join(labels, F.col("node") == F.col("nid"), "left").select("key", "tag", "node", "weight", F.coalesce("label", "node").alias("label"))
    per_label = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("heavy"))
    main = F.max(F.struct("rows", "heavy", "label"))
    open_ = per_label.groupBy("key").agg(main.alias("main"), F.sum("rows").alias("rows"), F.sum("heavy").alias("heavy"), F.count(F.lit(1)).alias("labels"))
    open_ = open_.where("labels > 1").select(
        "key", F.col("main.label").alias("main"), _parts(F.col("main.rows"), F.col("main.heavy"), most_rows, most_weight).alias("main_parts"),
        _parts(F.col("rows") - F.col("main.rows"), F.col("heavy") - F.col("main.heavy"), most_rows, most_weight).alias("parts"),
    )
    rows = labelled.join(open_, "key").withColumn("usual", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("usual"), F.col("main_parts")).otherwise(F.col("parts"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def meeting(with_main: bool, other: Column) -> Column:
        usual = F.col("usual")
        first = F.when(usual, other).otherwise(F.col("own")) if with_main else F.least(F.col("own"), other)
        second = F.when(usual, F.col("own")).otherwise(other) if with_main else F.greatest(F.col("own"), other)
        side = usual.cast("int") if with_main else (F.col("own") > other).cast("int")
        alone = F.lit(False) if with_main else F.col("own") == other
        return F.struct(F.xxhash64("key", F.lit(with_main), first, second).alias("block"), side.alias("side"), alone.alias("alone"))

    strangers = F.transform(upto("parts"), lambda other: meeting(False, other))
    against_main = F.transform(F.when(F.col("usual"), upto("parts")).otherwise(upto("main_parts")), lambda other: meeting(True, other))
    blocks = F.when(F.col("usual"), against_main).otherwise(F.concat(against_main, strangers))
    return rows.select("node", "weight", "label", "tag", F.inline(blocks))


def group_blocks(members: DataFrame, most_rows: int) -> DataFrame:
    """(key, node) once for every pair of blocks of its group, groups of one left out: node, block, side, alone."""
    parts = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rows = members.join(parts.select("key", F.ceil(F.col("rows") / most_rows).cast("int").alias("parts")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            F.xxhash64("key", F.least(F.col("own"), other), F.greatest(F.col("own"), other)).alias("block"),
            (F.col("own") > other).cast("int").alias("side"), (F.col("own") == other).alias("alone"),
        ),
    )
    return rows.select("node", F.inline(met))
