"""Sketches within their bounds and equal after merging; groupings equal to plain ones."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curatorium.operators import cubes as K
from curatorium.operators import sketches as S

SPECS = [S.Sketch("q", "quantiles", "v", 200), S.Sketch("d", "distinct", "u", 10), S.Sketch("i", "items", "w", 64)]


@pytest.fixture(scope="module")
def rows(spark):
    # group 0 holds nine tenths of the rows; w is skewed, u has many values, some rows have none
    df = spark.range(200_000, numPartitions=16)
    return df.select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 70 / 10).otherwise(0).cast("int").alias("g"), (F.col("id") % 16).alias("day"),
        F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30_000)).alias("u"),
        F.floor(F.sqrt(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2500)))).alias("w"),
    ).cache()


@pytest.fixture(scope="module")
def stored(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "stored")
    for half in (0, 1):
        S.sketch(rows.where(F.col("day") % 2 == half), ["g", "day"], SPECS).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def test_quantiles_within_the_bound(rows, stored):
    found = S.quantiles(S.merge(stored, ["g"], SPECS).select("g", "rows", "q"), SPECS[0], [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])
    valued = rows.where("v is not null")
    checked = valued.join(found.drop("rows"), "g").groupBy("g", "probability").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value")).alias("a"), F.count_if(F.col("v") <= F.col("value")).alias("b"))
    error = S.rank_error(200)
    out = checked.collect()
    assert len(out) == 7 * 7 and error < 0.02
    assert all(r.a / r.n - error <= r.probability <= r.b / r.n + error for r in out)


def test_distinct_within_the_bound_and_equal_in_one_pass(rows, stored):
    estimate, low, high = S.distinct_bounds(SPECS[1])
    merged = S.merge(stored, ["g"], SPECS).select("g", estimate.alias("e"), low.alias("low"), high.alias("high"))
    once = S.sketch(rows, ["g"], SPECS).select("g", estimate.alias("once"))
    truth = rows.groupBy("g").agg(F.count_distinct("u").alias("n"))
    for r in merged.join(once, "g").join(truth, "g").collect():
        assert r.low <= r.n <= r.high and abs(r.e - r.once) <= 0.1 * r.n


def test_frequent_items_are_exact_while_all_are_tracked(rows, stored):
    big = [S.Sketch("i", "items", "w", 1024)]
    counts = {(r.g, r.w): r["count"] for r in rows.groupBy("g", "w").count().collect()}
    merged = S.merge(S.sketch(rows, ["g", "day"], big), ["g"], big).select("g", "i")
    assert {(r.g, r.item): r["items"] for r in S.frequent(merged, big[0], 1000).collect()} == counts
    # with fewer tracked the heavy ones are there
    small = {(r.g, r.item) for r in S.frequent(S.merge(stored, ["g"], SPECS).select("g", "i"), SPECS[2], 64).collect()}
    sizes = defaultdict(int)
    for (g, _), n in counts.items():
        sizes[g] += n
    assert all(key in small for key, n in counts.items() if n > sizes[key[0]] * 8 / (3 * 64))


def test_overlap_of_sketches(spark):
    spec = S.Sketch("d", "distinct", "u", 12)
    a, b = (spark.range(lo, lo + 3000).select(F.lit(1).alias("g"), F.col("id").alias("u")) for lo in (0, 2000))
    left, right = S.sketch(a, ["g"], [spec]).select("g", F.col("d").alias("x")), S.sketch(b, ["g"], [spec]).select("g", F.col("d").alias("y"))
    assert left.join(right, "g").select(S.overlap(F.col("x"), F.col("y")).alias("n")).first()[0] == 1000


def test_groups_of_nulls_and_nothing(spark):
    empty = spark.createDataFrame([(1, None, None, None)], "g int, v long, u long, w long")
    one = S.sketch(empty, ["g"], SPECS)
    assert S.quantiles(one.select("g", "rows", "q"), SPECS[0], [0.5]).first()["value"] is None
    assert one.select(S.distinct_bounds(SPECS[1])[0]).first()[0] == 0
    assert S.sketch(empty.limit(0), ["g"], SPECS).count() == 0


@pytest.mark.parametrize("sets", [K.cube_sets, K.rollup_sets, lambda d: [("b",), ("a", "c")]])
def test_groupings_equal_plain_ones(spark, sets):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(3), rng.choice([True, None]), rng.choice([None, *range(0, 200_000, 9973), -5]), rng.randrange(-9, 9)) for _ in range(400)]
    dims = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "a string, b int, c boolean, u long, v int")
    got = K.grouped(df, dims, sets(dims), {"n": F.lit(True), "low": F.col("v") < 0}, {"total": F.col("v")}, ("ids", "u"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 or plan.count("LocalTableScan") == 1
    want = []
    for chosen in sets(dims):
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(r[i] if d in chosen else None for i, d in enumerate(dims))].append(r)
        level = sum((d not in chosen) << (2 - i) for i, d in enumerate(dims))
        want += [(*k, level, len(g), sum(r[4] < 0 for r in g), sum(r[4] for r in g), len({r[3] for r in g} - {None})) for k, g in groups.items()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert K.grouped(df.limit(0), dims, sets(dims), {"n": F.lit(True)}).count() == 0
