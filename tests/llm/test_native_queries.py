"""Quality rules and URL filters: SQL over the tables and over the awkward rows."""

import datetime

import duckdb
import pytest
from fixtures import SF, edge

from curatorium.llm import quality, registry, urls
from tools.check import compare, connect, rows_of

registry.load_all()


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_url_filters"])
def test_query_equals_sql(spark, name):
    status, _, _, detail = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert status == "OK", detail


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_url_filters"])
def test_no_python_in_the_plan(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_quality_of_awkward_rows_equals_sql(spark, tmp_path):
    edge(spark).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(quality.ORACLE)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = quality.op5_quality_rules(spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want


def test_quality_replaces_clashing_columns_and_can_be_filtered(spark):
    found = quality.quality(edge(spark))
    assert found.columns.count("kept") == 1 and "odd.name" in found.columns
    assert found.where("kept").count() == sum(r["kept"] for r in found.collect())
    assert quality.quality(edge(spark).limit(0)).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    found = quality.quality(docs).where("n_words >= 50 and not base_failed").join(labels, "doc_id")
    rates = {r["quality"]: r["share"] for r in found.groupBy("quality").agg({"kept": "count"}).join(found.where("kept").groupBy("quality").count(), "quality").selectExpr("quality", "count / `count(kept)` as share").collect()}
    assert rates[1] > 0.99 and rates.get(0, 0) < 0.15


DAY = datetime.date


def test_url_intervals_ties_and_nulls(spark):
    captures = spark.createDataFrame(
        [
            (1, "http://a.b.com/x/y?z", DAY(2024, 1, 31), "c"), (2, "http://a.b.com/x/y", DAY(2024, 2, 1), "c"), (3, "https://u@B.com:80/", DAY(2024, 3, 5), "c"),
            (4, None, DAY(2024, 1, 1), "c"), (5, "http://a.b.com/x", None, "c"), (6, "nonsense", DAY(2024, 1, 1), "c"), (7, "http://a.b.com/q", DAY(2024, 2, 10), "c"),
            (7, "http://a.b.com/q", DAY(2024, 2, 10), "c"),
        ],
        "id int, url string, fetched_on date, kept string",
    )
    entries = spark.createDataFrame(
        [
            ("domain", "b.com", "block", DAY(2024, 2, 1), "add"), ("domain", "b.com", "block", DAY(2024, 2, 1), "add"), ("domain", "b.com", "block", DAY(2024, 3, 5), "remove"),
            ("prefix", "a.b.com/x", "allow", DAY(2023, 12, 1), "add"), ("domain", "a.b.com", "block", DAY(2024, 1, 1), "add"), ("domain", "a.b.com", "block", DAY(2024, 1, 1), "remove"),
            ("domain", None, "block", DAY(2024, 1, 1), "add"), ("domain", "com", "block", None, "add"),
        ],
        "kind string, key string, list string, listed_on date, action string",
    )
    got = {(r["id"], r["n_active"], r["decided_by"], r["kept"]) for r in urls.url_filter(captures, entries).collect()}
    assert got == {
        (1, 1, "prefix:a.b.com/x", True), (2, 2, "prefix:a.b.com/x", True), (3, 0, "", True), (4, 0, "", True), (5, 0, "", True), (6, 0, "", True), (7, 1, "domain:b.com", False),
    }
    assert urls.url_filter(captures, entries).count() == 8
    assert urls.url_filter(captures, entries.limit(0)).where("kept").count() == 8
    assert urls.url_filter(captures.limit(0), entries).count() == 0
