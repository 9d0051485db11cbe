"""Every grouping of some dimensions in one scan: cube, rollup or chosen sets, with filtered counts and exact distinct counts.

Rows are added up once at the finest grouping; the coarser ones are expanded from that small table, not from the rows.
Distinct ids are kept as bitmaps per run of 32,768 ids, which OR together, so a distinct count over any grouping is exact
without a second look at the ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_sets(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for n in range(len(dimensions), -1, -1) for s in combinations(dimensions, n)]


def rollup_sets(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dimensions[:n]) for n in range(len(dimensions), -1, -1)]


def grouped(
    rows: DataFrame,
    dimensions: Sequence[str],
    sets: Sequence[Sequence[str]],
    counts: dict[str, Column],
    sums: dict[str, Column] | None = None,
    distinct: tuple[str, str] | None = None,
) -> DataFrame:
    """dimensions, grouping (bit set where a dimension is left out, the first one highest), counts, sums and the distinct count.

    ``counts`` are conditions, ``sums`` whole numbers; ``distinct`` is (name, column of whole numbers).  A null dimension
    value is a value of its own, told from a total by ``grouping``.  Without rows there is no group, not even a total.
    """
    sums = sums or {}
    run = F.bitmap_bucket_number(F.col(distinct[1]).cast("long")) if distinct else F.lit(0).cast("long")
    cells = rows.withColumn("__run", run)
    # a plain group-by for the rows; bitmaps only for rows that have an id
    partial = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()] + [F.sum(c).alias(n) for n, c in sums.items()]
    if distinct:
        place = F.bitmap_bit_position(F.col(distinct[1]).cast("long"))
        partial.append(F.bitmap_construct_agg(F.when(F.col(distinct[1]).isNotNull(), place)).alias("__ids"))
    finest = cells.groupBy(*dimensions, "__run").agg(*partial)
    parts = [[*[F.col(d) for d in s], F.col("__run")] for s in sets]
    added = [F.sum(n).alias(n) for n in (*counts, *sums)] + ([F.bitmap_or_agg("__ids").alias("__ids")] if distinct else [])
    level = F.lit(0)
    for d in dimensions:
        level = level * 2 + F.grouping(d).cast("int")
    by_run = finest.groupingSets(parts, *[F.col(d) for d in dimensions], F.col("__run")).agg(level.alias("grouping"), *added)
    whole = [F.sum(n).alias(n) for n in (*counts, *sums)] + ([F.sum(F.bitmap_count("__ids")).alias(distinct[0])] if distinct else [])
    return by_run.groupBy(*dimensions, "grouping").agg(*whole)
