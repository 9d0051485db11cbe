"""Window results for groups too large for one task.

A plain window sorts a whole group in one task.  These helpers cut every group
into ordered buckets (a coarse prefix of the sort order chosen by the caller),
run the window inside each bucket, and shift each bucket by totals taken from a
small per-bucket summary.  A bucket expression such as ``floor(ord / 2**18)``
over a unique integer bounds the rows one task sorts regardless of skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.session import stored

BUCKET_WIDTH = 1 << 18


def integer_bucket(column: str | Column, width: int = BUCKET_WIDTH) -> Column:
    """Coarse, order-preserving bucket of a unique integer column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(width)).cast("bigint")


def hash_bucket(column: str | Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest: ordered like the digest and evenly filled."""
    return F.substring(column, 1, digits)


def _ordered(buckets: Sequence[tuple[Column, bool]]) -> tuple[list[str], list[Column]]:
    names = [f"__bucket{i}" for i in range(len(buckets))]
    order = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, buckets)]
    return names, order


def _with_buckets(df: DataFrame, buckets: Sequence[tuple[Column, bool]]) -> DataFrame:
    return df.withColumns({f"__bucket{i}": expr for i, (expr, _) in enumerate(buckets)})


def ranked(
    df: DataFrame,
    parts: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[tuple[Column, bool]],
    out: str = "rn",
    size_out: str | None = None,
) -> DataFrame:
    """1-based ``row_number`` per ``parts`` group, and optionally the group size.

    ``buckets`` is a list of (expression, ascending) forming a coarse prefix of
    ``order``.  Group and bucket columns must be non-null.
    """
    names, border = _ordered(buckets)
    df = _with_buckets(df, buckets)
    keys = [*parts, *names]
    before = Window.partitionBy(*parts).orderBy(*border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    if size_out:
        offsets = offsets.withColumn(size_out, F.sum("__n").over(Window.partitionBy(*parts)))
    local = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = local.join(offsets.drop("__n"), keys)
    return joined.withColumn(out, (F.col("__rn") + F.col("__offset")).cast("bigint")).drop(
        "__rn", "__offset", *names
    )


def running_sums(
    df: DataFrame,
    parts: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[tuple[Column, bool]],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums.  Sum integers (cents, counts) so order cannot change the result."""
    names, border = _ordered(buckets)
    df = _with_buckets(df, buckets).withColumns({f"__v_{k}": v for k, v in sums.items()})
    keys = [*parts, *names]
    before = Window.partitionBy(*parts).orderBy(*border).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    totals = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"__l_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in sums})
    out = local.join(totals, keys).withColumns({k: F.col(f"__l_{k}") + F.col(f"__o_{k}") for k in sums})
    return out.drop(*names, *[f"__{p}_{k}" for p in "vlo" for k in sums])


def previous(
    df: DataFrame,
    parts: Sequence[str],
    order_column: str,
    bucket: Column,
    columns: dict[str, str],
) -> DataFrame:
    """``lag(source)`` per group ordered by a unique ascending column, as {new_name: source}."""
    df = df.withColumn("__bucket0", bucket)
    keys = [*parts, "__bucket0"]
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    tail = df.groupBy(*keys).agg(F.max_by(packed, F.col(order_column)).alias("__last"))
    across = Window.partitionBy(*parts).orderBy("__bucket0")
    tail = tail.select(*keys, F.lag("__last").over(across).alias("__carry"))
    inside = Window.partitionBy(*keys).orderBy(order_column)
    local = df.withColumn("__prev", F.lag(packed).over(inside))
    out = local.join(tail, keys).withColumn("__prev", F.coalesce("__prev", "__carry"))
    return out.withColumns({n: F.col(f"__prev.{n}") for n in columns}).drop("__prev", "__carry", "__bucket0")


def earlier_max(
    df: DataFrame,
    parts: Sequence[str],
    order_column: str,
    bucket: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Greatest value over the rows before each row, per group ordered by a unique column.

    Values may be structs, so a struct starting with the order column gives the
    latest earlier row that has one.
    """
    df = df.withColumn("__bucket0", bucket).withColumns({f"__v_{k}": v for k, v in values.items()})
    keys = [*parts, "__bucket0"]
    before = Window.partitionBy(*parts).orderBy("__bucket0").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*keys).agg(*[F.max(f"__v_{k}").alias(f"__t_{k}") for k in values])
    carry = carry.select(*keys, *[F.max(f"__t_{k}").over(before).alias(f"__o_{k}") for k in values])
    inside = Window.partitionBy(*keys).orderBy(order_column).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"__l_{k}": F.max(f"__v_{k}").over(inside) for k in values})
    out = local.join(carry, keys).withColumns({k: F.greatest(f"__l_{k}", f"__o_{k}") for k in values})
    return out.drop("__bucket0", *[f"__{p}_{k}" for p in "vlo" for k in values])


def discrete_quantiles(
    df: DataFrame,
    parts: Sequence[str],
    value: str,
    positions: dict[str, Column],
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Exact order statistics of an integer column.

    ``positions`` maps an output name to a 1-based position written over the
    group size column ``n``.  Equal values are counted first, so a hot value is
    one row, and the cumulative count is bucketed by value.
    """
    if not parts:
        return discrete_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, positions, width).drop("__all")
    counts = df.where(F.col(value).isNotNull()).groupBy(*parts, value).agg(F.count(F.lit(1)).alias("__c"))
    cumulative = running_sums(
        counts, parts, [F.col(value).asc()], [(integer_bucket(value, width), True)], {"__cum": F.col("__c")}
    )
    sizes = counts.groupBy(*parts).agg(F.sum("__c").alias("n"))
    picks = [
        F.min(F.when(F.col("__cum") >= position, F.col(value))).alias(name)
        for name, position in positions.items()
    ]
    return cumulative.join(sizes, list(parts)).groupBy(*parts).agg(*picks, F.max("n").alias("n"))


def ntile(df: DataFrame, parts: Sequence[str], order: Sequence[Column], buckets: Sequence[tuple[Column, bool]], tiles: int, out: str = "tile") -> DataFrame:
    """``ntile(tiles)`` per group: equal shares in order, the first ones a row larger."""
    rows = ranked(df, parts, order, buckets, "__place", "__size") if parts else ranked(df.withColumn("__all", F.lit(0)), ["__all"], order, buckets, "__place", "__size").drop("__all")
    share, rest = F.floor(F.col("__size") / tiles), F.col("__size") % tiles
    edge = rest * (share + 1)  # rows in the larger tiles
    tile = F.when(F.col("__place") <= edge, F.ceil(F.col("__place") / (share + 1))).otherwise(rest + F.ceil((F.col("__place") - edge) / F.greatest(share, F.lit(1))))
    return rows.withColumn(out, tile.cast("int")).drop("__place", "__size")


def value_ranks(df: DataFrame, parts: Sequence[str], value: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """(parts, value, rows, rank, dense_rank, percent_rank, cume_dist): one row per value of a whole-number column.

    Equal values are counted first, so neither a hot group nor a hot value is sorted; rows meet their value by a join where
    they need its rank.  Null values have no rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*parts, value).agg(F.count(F.lit(1)).alias("rows"))
    keyed = counts if parts else counts.withColumn("__all", F.lit(0))
    keys = list(parts) or ["__all"]
    placed = running_sums(keyed, keys, [F.col(value).asc()], [(integer_bucket(value, width), True)], {"__upto": F.col("rows"), "dense_rank": F.lit(1)})
    sizes = keyed.groupBy(*keys).agg(F.sum("rows").alias("__size"))
    below = F.col("__upto") - F.col("rows")
    return placed.join(sizes, keys).select(
        *parts, value, "rows", (below + 1).alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"),
        F.when(F.col("__size") > 1, below / (F.col("__size") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        (F.col("__upto") / F.col("__size")).alias("cume_dist"),
    )


def sliding_totals(
    df: DataFrame, parts: Sequence[str], at: str, before: int, after: int, sums: dict[str, Column], highest: dict[str, Column] | None = None, width: int | None = None
) -> DataFrame:
    """Totals over the range from ``before`` behind to ``after`` ahead of every value of a whole-number or date column.

    One row per group and value: parts, at, rows, the sums and maxima over the range.  Rows of one value are added up first;
    then every value goes to the bucket that it lies in and, as a guest, to the buckets whose ranges reach it, so a bucket
    holds at most ``width`` + ``before`` + ``after`` rows whatever the size of the group.  Null values are left out.
    """
    highest = highest or {}
    width = width or max(1, before + after)
    is_date = dict(df.dtypes)[at] == "date"
    number = F.unix_date(F.col(at)) if is_date else F.col(at)
    daily = df.where(F.col(at).isNotNull()).groupBy(*parts, number.cast("long").alias("__at"))
    daily = daily.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in highest.items()])
    cell = lambda x: F.floor(x / width).cast("long")
    placed = daily.withColumn("__bucket", F.explode(F.sequence(cell(F.col("__at") - after), cell(F.col("__at") + before))))
    frame = Window.partitionBy(*parts, "__bucket").orderBy("__at").rangeBetween(-before, after)
    totals = placed.select(
        *parts, "__at", "__bucket", F.sum("rows").over(frame).alias("rows"), *[F.sum(n).over(frame).alias(n) for n in sums], *[F.max(n).over(frame).alias(n) for n in highest]
    )
    own = totals.where(F.col("__bucket") == cell(F.col("__at")))
    value = F.date_from_unix_date(F.col("__at").cast("int")) if is_date else F.col("__at").cast(dict(df.dtypes)[at])
    return own.select(*parts, value.alias(at), "rows", *sums, *highest)


def placed(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """1-based position of every row in the order of the whole table, which must be total.

    Spark sorts by ranges of the whole key, so a frequent first value spreads; the sorted table is written once with each
    row's partition and place in it, and partitions are shifted by the rows before them, one number per partition.
    """
    inside = F.monotonically_increasing_id()  # partition number and place in the partition
    rows = stored(df.orderBy(*order).withColumn("__at", inside), "sorted").withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return rows.join(F.broadcast(shifts), "__part").withColumn(out, place).drop("__at", "__part", "__before")
