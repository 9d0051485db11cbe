"""Summaries of fixed size that are stored per group and merged later: quantiles, distinct counts, frequent items.

``sketch`` makes one row per group; ``merge`` adds stored rows up to coarser groups without the data they came from.  Spark
builds a sketch per task and group before the shuffle, so a group that holds most of the rows costs as much as any other.

Error bounds: a quantile's true rank lies within ``rank_error(k)`` of the rank asked for (99 per cent); distinct counts are
exact up to 2^size values and within three times 2^(-size/2) of the truth beyond (99.7 per cent); counts of frequent items
are exact while a group has fewer than three quarters of ``size`` different items, and an item is never missed whose share
exceeds 8 / (3 * size).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sketch:
    """``kind`` is quantiles (of whole numbers), distinct or items; ``size`` its k, the logarithm of its entries, or the items it tracks."""

    name: str
    kind: str
    column: str
    size: int

    def build(self) -> Column:
        c = F.col(self.column)
        if self.kind == "quantiles":
            return F.kll_sketch_agg_bigint(c.cast("long"), self.size)
        if self.kind == "distinct":
            return F.theta_sketch_agg(c, self.size)
        if self.kind == "items":
            return F.call_function("approx_top_k_accumulate", c, F.lit(self.size))
        raise ValueError(f"kind {self.kind}")

    def combine(self) -> Column:
        c = F.col(self.name)
        if self.kind == "quantiles":
            return F.kll_merge_agg_bigint(c, self.size)
        return F.theta_union_agg(c, self.size) if self.kind == "distinct" else F.call_function("approx_top_k_combine", c, F.lit(self.size))


def sketch(rows: DataFrame, keys: Sequence[str], specs: Sequence[Sketch]) -> DataFrame:
    """keys, rows and a sketch per spec.  Null values count as rows and enter no sketch."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[s.build().alias(s.name) for s in specs])


def merge(stored: DataFrame, keys: Sequence[str], specs: Sequence[Sketch]) -> DataFrame:
    """The sketches of coarser groups, from the stored ones alone."""
    return stored.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[s.combine().alias(s.name) for s in specs])


def rank_error(k: int) -> float:
    """Bound of the distance between the rank asked for and the true one, in 99 of 100 cases (fixed: published for these sketches)."""
    return 2.296 / k**0.9021


def quantiles(stored: DataFrame, spec: Sketch, probabilities: Sequence[float]) -> DataFrame:
    """A row per group and probability: probability, value (null for a group without values)."""
    held = F.col(spec.name)
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.when(F.kll_sketch_get_n_bigint(held) > 0, F.kll_sketch_get_quantile_bigint(held, asked))
    pairs = F.transform(asked, lambda p, i: F.struct(p.alias("probability"), F.get(values, i).alias("value")))
    kept = [c for c in stored.columns if c not in (spec.name,)]
    return stored.withColumn("__pairs", pairs).select(*kept, F.inline("__pairs"))


def distinct_bounds(spec: Sketch) -> tuple[Column, Column, Column]:
    """(estimate, low, high) of the distinct values of a stored sketch."""
    estimate = F.theta_sketch_estimate(spec.name)
    spread = F.when(estimate <= 1 << spec.size, F.lit(0.0)).otherwise(F.lit(3.0) / F.sqrt(F.lit(float(1 << spec.size))))
    return estimate, F.floor(estimate / (1 + spread)), F.ceil(estimate / (1 - spread))


def overlap(first: Column, second: Column) -> Column:
    """Estimated number of values that two distinct sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(first, second))


def frequent(stored: DataFrame, spec: Sketch, most: int) -> DataFrame:
    """The ``most`` most frequent items of each group: item, items (their count)."""
    found = F.call_function("approx_top_k_estimate", F.col(spec.name), F.lit(most))
    kept = [c for c in stored.columns if c != spec.name]
    return stored.withColumn("__items", found).select(*kept, F.explode("__items").alias("__i")).select(*kept, F.col("__i.item").alias("item"), F.col("__i.count").alias("items"))
