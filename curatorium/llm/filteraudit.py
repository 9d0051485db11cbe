"""Filter interaction audit: what each of five filters removes under every order, by difference arrays over Lehmer ranks.

1. One pass over the texts gives a narrow row per document: its part, the mask of the filters that it fails by itself (A to
   D) and a SHA-256 digest of its text.  Filter E compares texts: a document fails it unless its doc_id is the smallest of
   its digest; smallest ids are aggregated before the shuffle and met on (digest, doc_id), so a hot text makes no hot key.
2. Documents are counted per (part, mask), at most 32 rows a part; everything later works on these counts.
3. The orders are ranked lexicographically (by their Lehmer codes), so all orders that share a prefix form an interval of
   ranks.  A document with a given mask is removed at step s by filter f exactly in the orders whose first s - 1 filters are
   outside the mask and whose s-th is f: ``INTERVALS`` lists these intervals, a fixed table.  Counts are added where an
   interval begins and subtracted where it ends, and a running sum over the 120 ranks gives what is removed at each step.
4. kept is the part's total less the running sum over steps; redundant is what fails the filter less what it removes;
   shapley sums what the filter removes over all orders.

Defined cases: a null text counts as empty, a null source as the part ''; a document without doc_id is compared with no
other and never fails E; rows that repeat a doc_id and text share it, so neither is smaller; of several label rows of a
doc_id any with quality = 1 (toxic = 1) counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatorium.llm.registry import query, table
from curatorium.llm.store import settle

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
BLANK = r"[\x20\x09-\x0D]+"
MEASURES = ["n", "good", "toxic"]


def intervals() -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first rank, rank after the last): the orders in which a mask is removed at a step by a filter."""
    size, found = len(FILTERS), []
    for step in range(1, size + 1):
        block = factorial(size - step)  # orders that share a prefix of this length
        # prefixes in lexicographic order take the ranks block by block
        for at, prefix in enumerate(permutations(range(size), step)):
            earlier = sum(1 << f for f in prefix[:-1])
            found += [(mask, step, prefix[-1], at * block, (at + 1) * block) for mask in range(1 << size) if mask >> prefix[-1] & 1 and not mask & earlier]
    return found


INTERVALS = intervals()


def _fails(text: Column) -> Column:
    """The mask of the filters that depend on the text alone."""
    words = F.array_remove(F.split(text, BLANK), "")
    n = F.size(words).cast("long")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    rules = [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * upper.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(rules)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        _fails(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = marked.agg(flag("quality"), flag("toxic"))
    rows = settle(rows, "filter-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("smallest"))
    first = first.select(F.col("digest").alias("of"), "smallest")
    rows = rows.join(first, (F.col("doc_id") == F.col("smallest")) & (F.col("digest") == F.col("of")), "left")
    repeats = F.col("doc_id").isNotNull() & F.col("smallest").isNull()
    rows = rows.select("doc_id", "part", (F.col("own") + F.when(repeats, 1 << 4).otherwise(0)).alias("mask"))
    rows = rows.join(marked, F.col("doc_id") == F.col("labelled"), "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of ``masks``, a written table."""
    spark = counts.sparkSession
    table_ = F.broadcast(spark.createDataFrame(INTERVALS, "mask int, step int, filter int, lo int, hi int"))  # fixed, whatever the input
    ends = F.array(
        F.struct(F.col("lo").alias("rank"), *[F.col(m) for m in MEASURES]),
        F.struct(F.col("hi").alias("rank"), *[(-F.col(m)).alias(m) for m in MEASURES]),
    )
    differences = counts.join(table_, "mask").select("part", "step", F.inline(ends)).where(F.col("rank") < ORDERS)
    # every cell exists, also where nothing changes
    cells = F.array([F.struct(F.lit(s).alias("step"), F.lit(r).alias("rank"), *[F.lit(0).cast("long").alias(m) for m in MEASURES]) for s in range(1, len(FILTERS) + 1) for r in range(ORDERS)])
    bit = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    failing = [F.sum(F.when(bit(k), F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*failing).alias("failing"), F.array(*alone).alias("alone"))
    grid = parts.select("part", F.inline(cells))
    steps = differences.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES])
    steps = steps.join(parts, "part").repartition("part")  # 600 rows a part from here on

    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = steps.select("part", "step", "rank", "total", "failing", "alone", *[F.sum(m).over(upto).alias(m) for m in MEASURES])
    orders = F.array([F.lit("".join(p)) for p in permutations(FILTERS)])
    removed = removed.withColumn("filter_order", F.get(orders, F.col("rank")))
    removed = removed.withColumn("filter", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    within = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return removed.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(within)).alias("kept"),
        F.col("n").alias("removed"),
        (F.get("failing", "filter") - F.col("n")).alias("redundant"),
        F.get("alone", "filter").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic)."""
    return audit(settle(masks(docs, labels), "filter-masks"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS fails
  FROM w
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)
),
s AS (SELECT filter_order, s AS step, filter_order[s] AS c, filter_order[1:s - 1] AS earlier FROM o, range(1, 6) AS r(s)),
g AS (
  SELECT part, filter_order, step, c,
    sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END) AS toxic_lost,
    sum(CASE WHEN translate(fails, earlier || c, '') = fails THEN n ELSE 0 END) AS kept
  FROM m, s GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM g
"""


@query("op13_filter_interactions", ORACLE)
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
