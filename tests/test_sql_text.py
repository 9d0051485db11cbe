"""Operators called from SQL text."""

import pytest
from pyspark.sql import functions as F

from curatorium import sql
from curatorium.operators import aggregates as A
from curatorium.operators import predicates as P
from curatorium.plans import load_all, registry

load_all()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, other", [("sql_slate_page", "slate_page"), ("sql_attempt_status", "attempt_status"), ("sql_filter_mood", "filter_mood")])
def test_calls_plan_the_operator(spark, name, other):
    plan, plain = (registry.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in (name, other))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert plan.count("FileScan") <= plain.count("FileScan") + 2  # the operator, and the rows that ask


def test_scalars_equal_the_column_expressions(spark):
    sql.install(spark, {})
    rows = spark.range(1, 40).selectExpr("id * 37 as y", "id * 41 as votes", "id % 7 as k", "id as n")
    got = rows.selectExpr("cur_decade(y)", "cur_popularity_band(votes)", "round(cur_wilson_low(least(k, n), n), 9)").collect()
    k, n = F.least("k", "n"), F.col("n")
    want = rows.select(P.decade(F.col("y")), P.popularity_band(F.col("votes")), F.round(A.wilson(k, n)[0], 9)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_functions_of_missing_views_are_left_out(spark):
    assert not set(sql.install(spark, {})) & {"cur_slate", "cur_status"}
    names = sql.install(spark, {"mood_items": spark.createDataFrame([("a", "x"), ("b", "y")], "id string, mood string")})
    assert "cur_in_mood" in names and [r.id for r in spark.sql("SELECT * FROM cur_in_mood('y')").collect()] == ["b"]
