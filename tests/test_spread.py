"""Bucketed windows equal plain windows, whatever the bucket width and input order."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curatorium.functions import spread


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(("hot" if rng.random() < 0.5 else rng.choice("abc")), i, rng.randrange(5), rng.randrange(100)) for i in range(400)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, ord bigint, score int, v bigint").repartition(7)


def collected(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("width", [1, 3, 64, 1 << 18])
def test_ranked(rows, width):
    order = [F.col("score").desc(), F.col("ord").asc()]
    got = spread.ranked(rows, ["g"], order, [(F.col("score"), False), (spread.integer_bucket("ord", width), True)], out="rn", size_out="n")
    w = Window.partitionBy("g")
    want = rows.withColumn("rn", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("n", F.count("*").over(w))
    assert collected(got, "g", "ord", "rn", "n") == collected(want, "g", "ord", "rn", "n")


@pytest.mark.parametrize("parts", [["g"], []])
def test_running_sums(rows, parts):
    got = spread.running_sums(rows, parts, [F.col("ord").asc()], [(spread.integer_bucket("ord", 10), True)], {"total": F.col("v")})
    w = Window.partitionBy(*parts).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    assert collected(got, "ord", "total") == collected(rows.withColumn("total", F.sum("v").over(w)), "ord", "total")


def test_previous_crosses_empty_buckets(rows):
    sparse = rows.where("ord % 50 < 3")
    got = spread.previous(sparse, ["g"], "ord", spread.integer_bucket("ord", 4), {"pv": "v", "po": "ord"})
    w = Window.partitionBy("g").orderBy("ord")
    want = sparse.withColumn("pv", F.lag("v").over(w)).withColumn("po", F.lag("ord").over(w))
    key = lambda df: sorted(map(str, df.select("ord", "pv", "po").collect()))
    assert key(got) == key(want)


def test_earlier_max(rows):
    got = spread.earlier_max(rows, ["g"], "ord", spread.integer_bucket("ord", 9), {"m": F.col("v")})
    w = Window.partitionBy("g").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    key = lambda df: sorted(map(str, df.select("ord", "m").collect()))
    assert key(got) == key(rows.withColumn("m", F.max("v").over(w)))


def test_discrete_quantiles(rows):
    n = F.col("n")
    got = spread.discrete_quantiles(rows, ["g"], "v", {"p90": F.floor((n * 9 + 9) / 10)}, width=10)
    data = {}
    for r in rows.collect():
        data.setdefault(r.g, []).append(r.v)
    want = {g: sorted(v)[-(-len(v) * 9 // 10) - 1] for g, v in data.items()}
    assert {r.g: r.p90 for r in got.collect()} == want


@pytest.mark.parametrize("tiles", [1, 3, 7, 1000])
@pytest.mark.parametrize("parts", [["g"], []])
def test_ntile(rows, tiles, parts):
    got = spread.ntile(rows, parts, [F.col("ord").asc()], [(spread.integer_bucket("ord", 9), True)], tiles)
    want = rows.withColumn("tile", F.ntile(tiles).over(Window.partitionBy(*parts).orderBy("ord")))
    assert collected(got, "ord", "tile") == collected(want, "ord", "tile")


@pytest.mark.parametrize("parts", [["g"], []])
@pytest.mark.parametrize("value", ["score", "v"])
def test_value_ranks(rows, parts, value):
    got = spread.value_ranks(rows, parts, value, width=2)
    w = Window.partitionBy(*parts).orderBy(value)
    names = ["rank", "dense_rank", "percent_rank", "cume_dist"]
    want = rows.select(*parts, value, *[getattr(F, n)().over(w).alias(n) for n in names]).distinct()
    assert collected(got, *parts, value, *names) == collected(want, *parts, value, *names)
    assert got.agg(F.sum("rows")).first()[0] == rows.count()


@pytest.mark.parametrize("before, after, width", [(3, 0, None), (0, 5, 1), (10, 10, 4), (0, 0, None), (200, 0, 7)])
@pytest.mark.parametrize("parts", [["g"], []])
def test_sliding_totals(spark, rows, before, after, width, parts):
    extra = rows.unionByName(spark.createDataFrame([("a", 999, 1, None), ("a", 998, 1, -40)], rows.schema))
    got = spread.sliding_totals(extra, parts, "v", before, after, {"total": F.col("score")}, {"most": F.col("ord")}, width)
    frame = Window.partitionBy(*parts).orderBy("v").rangeBetween(-before, after)
    plain = extra.where("v is not null")
    want = plain.select(*parts, "v", F.count("*").over(frame).alias("rows"), F.sum("score").over(frame).alias("total"), F.max("ord").over(frame).alias("most")).distinct()
    assert collected(got, *parts, "v", "rows", "total", "most") == collected(want, *parts, "v", "rows", "total", "most")


def test_sliding_totals_of_dates(spark):
    days = spark.sql("select 'x' as g, date_add(date'2024-01-01', cast(id * id as int)) as d, id as v from range(12)")
    got = {str(r.d): (r.rows, r.total) for r in spread.sliding_totals(days, ["g"], "d", 6, 0, {"total": F.col("v")}).collect()}
    at = [i * i for i in range(12)]
    want = {k: [j for j in range(12) if at[k] - 6 <= at[j] <= at[k]] for k in range(12)}
    assert sorted(got.values()) == sorted((len(js), sum(js)) for js in want.values())


def test_places_of_a_whole_table(rows):
    got = spread.placed(rows, [F.col("score").desc(), F.col("v").asc(), F.col("ord").asc()])
    want = rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "v", "ord")).cast("long"))
    assert collected(got, "ord", "place") == collected(want, "ord", "place")
    assert spread.placed(rows.limit(0), [F.col("ord").asc()]).count() == 0
