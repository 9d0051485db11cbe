"""Set accounting, digests, promotion and pseudonyms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import digest, reasons
from curatorium.operators.joins import keyed_counts


def tag_sets(sets: dict[str, DataFrame], id_column: str = "id") -> DataFrame:
    """(id, tag) of every set, distinct."""
    frames = [df.select(F.col(id_column).alias("id"), F.lit(tag).alias("tag")) for tag, df in sets.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def membership(tagged: DataFrame) -> DataFrame:
    """Per id the sorted tags holding it; the tags are a short fixed list."""
    return tagged.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def set_sizes(tagged: DataFrame) -> DataFrame:
    """Size of every set and of the union, in one pass over the membership rows."""
    per_set = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    union = tagged.select("id").distinct().agg(F.lit("union").alias("tag"), F.count(F.lit(1)).alias("n"))
    return per_set.unionByName(union.select("tag", "n"))


def set_accounting(tagged: DataFrame) -> DataFrame:
    """Number of ids per exact combination of sets; every invariant is a sum over these."""
    return membership(tagged).groupBy(F.array_join("tags", "+").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def intersection_counts(base: DataFrame, tagged: DataFrame) -> DataFrame:
    return (
        tagged.join(base.select("id").distinct(), "id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("shared"))
    )


def sets_equal(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows only in one side, and equality as multisets."""
    both = first.groupBy(*first.columns).agg(F.count(F.lit(1)).alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        second.groupBy(*second.columns).agg(F.lit(0).cast("bigint").alias("a"), F.count(F.lit(1)).alias("b"))
    )
    net = both.groupBy(*first.columns).agg((F.sum("a") - F.sum("b")).alias("d"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_second"),
        (F.count_if(F.col("d") != 0) == 0).alias("equal"),
    )


def row_digest(df: DataFrame, columns: Sequence[str] | None = None, out: str = "row_digest") -> DataFrame:
    return df.withColumn(out, digest(*(columns or df.columns)))


SLICES = 4  # of 15 hex digits each


def table_digest(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest and row count per group.

    Fixed slices of every row's digest are summed as integers, so tasks add up their own rows and only the sums are
    shuffled; the digest is that of the sums and the count.
    """
    columns = [c for c in df.columns if c not in groups]
    rows = df.select(*groups, digest(*columns).alias("__p"))
    number = lambda i: F.conv(F.substring("__p", 15 * i + 1, 15), 16, 10).cast("decimal(19,0)")
    sums = rows.groupBy(*groups).agg(*[F.sum(number(i)).alias(f"__s{i}") for i in range(SLICES)], F.count(F.lit(1)).alias("rows"))
    parts = [F.coalesce(F.col(f"__s{i}"), F.lit(0)).cast("string") for i in range(SLICES)]
    return sums.select(*groups, F.sha2(F.concat_ws(":", *parts, F.col("rows").cast("string")), 256).alias("digest"), "rows")


def promote_append(baseline: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The union, and one row per collision (key, value, how it collides)."""
    by_key = {key: F.col(key) for key in keys}
    counts = keyed_counts({"baseline": (baseline, by_key, {}), "accepted": (accepted, by_key, {})})
    found = reasons(
        (F.col("n_accepted") > 1, "DUPLICATE_IN_BATCH"),
        ((F.col("n_accepted") > 0) & (F.col("n_baseline") > 0) & F.col("value").isNotNull(), "ALREADY_IN_BASELINE"),
    )
    collisions = counts.select(F.col("kind").alias("key"), "value", F.explode(found).alias("kind"))
    return baseline.unionByName(accepted), collisions


def partition_conservation(tagged: DataFrame, population: DataFrame) -> DataFrame:
    """Per id in doubt: held by several partitions, by none, or outside the population."""
    held = tagged.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = population.select("id", F.lit(True).alias("__p")).join(held, "id", "full_outer")
    status = (
        F.when(F.col("__p").isNull(), "NOT_IN_POPULATION").when(F.col("n").isNull(), "UNASSIGNED").when(F.col("n") > 1, "OVERLAP")
    )
    return both.withColumn("problem", status).where(F.col("problem").isNotNull()).select("id", "problem")


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 hex built from two digests."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonymize(rows: DataFrame, id_column: str, secret: bytes, out: str = "pseudonym") -> DataFrame:
    return rows.withColumn(out, hmac_sha256(F.trim(F.col(id_column).cast("string")), secret)).drop(id_column)
