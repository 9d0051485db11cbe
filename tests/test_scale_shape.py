"""Plans keep the shape meant for large tables."""

import os

import pytest
from pyspark.sql import functions as F

from curatorium.operators import joins as J
from curatorium.operators import ranking as R
from curatorium.plans import load_all, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load_all()
QUERIES = registry.QUERIES
WIDE = ["filter_practical", "pool_exact_then_fallback", "blind_order", "dedup_best_per_key", "count_by", "anti_join_exclusions", "ordinal_diagnostics", "usage_totals", "ngram_overlap", "boundary_rules", "running_budget", "similar_items", "top_k_similar", "range_join_stratum", "selection_funnel", "quota_by_hash_rank", "select_candidates"]


@pytest.mark.parametrize("name", WIDE)
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_quota_is_cut_before_the_shuffle(spark):
    plan = QUERIES["quota_by_hash_rank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["count_by"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_shipdate" in plan


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, table, scans", [("join_blind_packets", "documents", 3), ("join_audit_gap", "documents", 6), ("assemble_production_rows", "part", 8)])
def test_complete_joins_read_each_role_once(spark, name, table, scans):
    plan = executed(QUERIES[name](spark, SF))
    assert plan.count(f"{table}.parquet") <= scans


def test_round_robin_is_cut_before_the_shuffle(spark):
    plan = executed(QUERIES["cell_quota_selection"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 8
    assert "Window.orderBy" not in plan


def test_many_seeds(spark):
    """More seeds than languages, ties by profile, repeated tags, items without any tag."""
    rows = []
    for i in range(150):
        moods = [["m1"], ["m1", "m2"], ["m2", "m2"], []][i % 4]
        rows.append((f"i{i:03}", i, moods, [f"g{i % 11}"] if i % 5 else [], None if i % 7 == 0 else "slow", "light", None, None, [f"s{i % 3}"] if i % 2 else []))
    rows += [(f"z{i}", 1000 + i, [], [], None, None, None, None, []) for i in range(4)]
    schema = "id string, ord long, moods array<string>, genres array<string>, pace string, emotional_weight string, attention_demand string, discovery_style string, situations array<string>"
    items = spark.createDataFrame(rows, schema)
    k, got = 7, {}
    for r in R.similar_items(items, items.where("ord < 120 or ord >= 1000"), k).collect():
        got.setdefault(r.seed_id, []).append((r.rn, r.id, r.score))

    def score(a, b):
        equal = sum(x is not None and x == y for x, y in zip(a[4:8], b[4:8]))
        return 2 * sum(v in b[2] for v in a[2]) + 2 * sum(v in b[3] for v in a[3]) + equal + sum(v in b[8] for v in a[8])

    seeds = [r for r in rows if r[1] < 120 or r[1] >= 1000]
    assert len(got) == len(seeds) > 64
    for s in seeds:
        best = sorted((-score(s, o), o[1], o[0]) for o in rows if o[0] != s[0])[:k]
        assert sorted(got[s[0]]) == [(n, i, -x) for n, (x, _, i) in enumerate(best, 1)]


def test_more_ranges_than_could_be_broadcast(spark):
    day = lambda n: F.date_format(F.date_add(F.lit("1990-01-01"), n), "yyyy-MM-dd")
    ranges = spark.range(12_000).select((F.col("id")).alias("r"), day(F.col("id").cast("int")).alias("gte"), day((F.col("id") + F.col("id") % 3).cast("int")).alias("lte"))
    rows = spark.range(400).select(F.col("id").alias("k"), day((F.col("id") * 31 % 12_100).cast("int")).alias("at")).unionByName(spark.range(1).select(F.lit(999).cast("long").alias("k"), F.lit(None).cast("string").alias("at")))
    found = J.range_join(rows, ranges, "at", "gte", "lte")
    assert "NestedLoop" not in executed(found) and "Cartesian" not in executed(found)
    got = sorted((r.k, -1 if r.r is None else r.r) for r in found.collect())
    want = []
    for k in range(400):
        at = k * 31 % 12_100
        hits = [r for r in range(max(0, at - 2), min(at, 11_999) + 1) if r <= at <= r + r % 3]
        want += [(k, r) for r in hits] or [(k, -1)]
    assert got == sorted([*want, (999, -1)])


def test_titles_meet_in_every_spelling(spark):
    held = spark.createDataFrame([(1, "Spider-Man"), (2, "The  Long Day"), (3, "!!")], "id long, title string")
    rows = spark.createDataFrame([(10, "Spiderman"), (11, "spider man"), (12, "THELONGDAY"), (13, "Spider Men"), (14, "?")], "id long, title string")
    assert sorted(r.id for r in J.firewall(rows, held).collect()) == [10, 11, 12]


@pytest.mark.parametrize("name, scans", [("join_facts_strict", 6), ("promote_append", 5), ("reconcile_one_to_one", 6), ("review_and_promote", 6)])
def test_reports_take_one_pass_per_side(spark, name, scans):
    assert executed(QUERIES[name](spark, SF)).count("FileScan") <= scans


def test_reports_name_every_broken_expectation(spark):
    curated = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), ("d", 9), ("e", 3), (None, 7)], "id string, tmdb_id long")
    facts = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("d", 4, "x"), ("e", 3, "x"), (None, 7, "x")], "id string, tmdb_id long, note string")
    rows, found = J.join_facts_strict(curated, facts)
    want = {("DUPLICATE_ID", "b"), ("DUPLICATE_TMDB_ID", "2"), ("DUPLICATE_TMDB_ID", "3"), ("MISSING_FACTS", "c"), ("MISSING_FACTS", None), ("ID_MISMATCH", "d")}
    assert {tuple(r) for r in found.collect()} == want and rows.count() == 5
    mapping = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5), ("d", 9), ("z", 5), ("e", 3)], "id string, tmdb_id long")
    got = {tuple(r) for r in J.reconcile_one_to_one(curated.where("id <> 'b'").unionByName(curated.where("id = 'b'").limit(1)), mapping, facts).collect()}
    assert got == {
        ("DUPLICATE_MAPPING_ID", "a"), ("DUPLICATE_MAPPED_TMDB_ID", "1"), ("DUPLICATE_MAPPED_TMDB_ID", "5"), ("MAPPING_WITHOUT_CURATED_ROW", "z"), ("MISSING_MAPPING", "c"), ("MISSING_FACTUAL_SNAPSHOT", "c"),
        ("MAPPING_ID_DIFFERS", "b"), ("FACTS_ID_DIFFERS", "d"),
    }


def test_images_are_dealt_over_more_tasks_as_pixels_grow(spark, monkeypatch):
    from curatorium.operators import pixels as P

    monkeypatch.setattr(P, "PIXELS_PER_TASK", 256, raising=False)
    shade = F.col("id") % 5 * 50
    table = lambda images: spark.range(images * 64).select(
        F.floor(F.col("id") / 64).alias("image"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") % 64 / 8).alias("y"), *[shade.alias(c) for c in "rgb"], F.lit(255).alias("a")
    )
    tasks = {}
    for images in (16, 128):
        found = P.two_color_palette(P.palette_evidence(P.color_histogram(table(images)))).select("image", "valid", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.image, r.valid) for r in found) == [(i, 64) for i in range(images)]
        tasks[images] = len({r.task for r in found})
    # the session deals out to 8 partitions unless told otherwise
    assert tasks[16] <= 5 and 16 < tasks[128] <= 33
    assert P.color_histogram(table(1).where("image < 0")).count() == 0
