"""Filter boundaries, relaxation, ranking and paging on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from curatorium.operators import filters, ranking, slates

COLUMNS = "id string, ord bigint, title string, moods array<string>, situations array<string>, genres array<string>, languages array<string>, pace string, emotional_weight string, attention_demand string, discovery_style string, runtime_minutes int"


def item(i, **over):
    base = dict(
        id=f"m{i}", ord=i, title=f"T{i}", moods=["funny"], situations=["alone"], genres=["drama"], languages=["en"], pace="medium",
        emotional_weight="moderate", attention_demand="easy", discovery_style="familiar", runtime_minutes=110,
    )
    return tuple({**base, **over}.values())


def requests(spark, *rows):
    names = "request_id mood situation genres runtime language pace emotional_weight attention_demand discovery_style avoid_heavy avoid_slow under_two_hours page_offset".split()
    base = dict.fromkeys(names, "") | dict(request_id=1, mood="funny", avoid_heavy=False, avoid_slow=False, under_two_hours=False, page_offset=0)
    return spark.createDataFrame(
        [tuple((base | r).values()) for r in rows],
        "request_id int, " + ", ".join(f"{n} string" for n in names[1:10]) + ", avoid_heavy boolean, avoid_slow boolean, under_two_hours boolean, page_offset int",
    )


def pool(catalogue, wanted):
    return filters.with_score(filters.drop_dealbreakers(filters.relax_if_few(filters.match_requests(catalogue, wanted))))


def ids(df):
    return [r.id for r in df.orderBy("position").collect()]


@pytest.mark.parametrize("minutes,bucket", [(99, "short"), (100, "medium"), (130, "medium"), (131, "long")])
def test_runtime_buckets(spark, minutes, bucket):
    assert spark.range(1).select(filters.runtime_bucket(F.lit(minutes))).first()[0] == bucket


def test_dealbreakers_keep_only_the_easy_fit(spark):
    rows = [item(1, runtime_minutes=95), item(2, emotional_weight="heavy"), item(3, pace="slow"), item(4, runtime_minutes=120)]
    cat = spark.createDataFrame(rows, COLUMNS)
    wanted = requests(spark, dict(avoid_heavy=True, avoid_slow=True, under_two_hours=True))
    assert ids(ranking.rank_pool(pool(cat, wanted))) == ["m1"]


def test_no_mood_gives_nothing_and_genres_are_all_required(spark):
    cat = spark.createDataFrame([item(1, genres=["drama", "crime"]), item(2)], COLUMNS)
    assert pool(cat, requests(spark, dict(mood=""))).count() == 0
    assert [r.id for r in pool(cat, requests(spark, dict(genres="drama,crime"))).collect()] == ["m1"]


def test_null_values_do_not_match(spark):
    cat = spark.createDataFrame([item(1, pace=None, languages=None)], COLUMNS)
    assert pool(cat, requests(spark, dict(pace="slow"))).count() == 0
    assert pool(cat, requests(spark, dict(language="en"))).count() == 0
    assert pool(cat, requests(spark, dict(avoid_slow=True))).count() == 1


def test_situation_is_relaxed_below_three_and_exact_rows_lead(spark):
    rows = [item(1, situations=["friends"]), item(2), item(3, discovery_style="different"), item(4, moods=["emotional"])]
    cat = spark.createDataFrame(rows, COLUMNS).repartition(3)
    wanted = requests(spark, dict(situation="friends", discovery_style="different"))
    assert ids(ranking.rank_pool(pool(cat, wanted))) == ["m1", "m3", "m2"]
    three = spark.createDataFrame([item(i, situations=["friends"]) for i in (1, 2, 3)] + [item(4)], COLUMNS)
    assert ids(ranking.rank_pool(pool(three, wanted))) == ["m1", "m2", "m3"]


@pytest.mark.parametrize("n,offset,want,following", [(5, 3, ["m4", "m5", "m1"], 1), (2, 9, ["m1", "m2"], 0), (3, 1, ["m1", "m2", "m3"], 0), (4, 9, ["m2", "m3", "m4"], 0)])
def test_pages_wrap(spark, n, offset, want, following):
    cat = spark.createDataFrame([item(i) for i in range(1, n + 1)], COLUMNS)
    page = ranking.slate_page(ranking.rank_pool(pool(cat, requests(spark, dict(page_offset=offset)))))
    got = page.orderBy("slot").collect()
    assert [r.id for r in got] == want and {r.next_offset for r in got} == {following}


def test_similar_items_by_brute_force(spark):
    rows = [item(i, moods=["funny"] if i % 2 else ["funny", "exciting"], pace="slow" if i % 3 else "fast", genres=["drama"] if i % 5 else ["crime"]) for i in range(1, 40)]
    cat = spark.createDataFrame(rows, COLUMNS).repartition(5)
    seeds = cat.where("ord IN (1, 2)")
    got = {(r.seed_id, r.rn): r.id for r in ranking.similar_items(cat, seeds, 3).collect()}
    data = [r.asDict() for r in cat.collect()]

    def score(s, o):
        shared = lambda c: sum(v in o[c] for v in s[c])
        return 2 * shared("moods") + 2 * shared("genres") + shared("situations") + sum(s[c] == o[c] for c in ("pace", "emotional_weight", "attention_demand", "discovery_style"))

    for s in (d for d in data if d["ord"] in (1, 2)):
        best = sorted((d for d in data if d["id"] != s["id"]), key=lambda d: (-score(s, d), d["ord"]))[:3]
        assert [got[s["id"], k] for k in (1, 2, 3)] == [d["id"] for d in best]


def test_outlier_of_three(spark):
    cat = spark.createDataFrame([item(1, attention_demand="immersive", emotional_weight="heavy"), item(2), item(3)], COLUMNS)
    slate = ranking.slate_page(ranking.rank_pool(pool(cat, requests(spark, {}))))
    row = slates.outlier_of_three(slate).first()
    assert (row.outlier_id, row.majority_ids, row.dimensions) == ("m1", ["m2", "m3"], ["attention_demand", "emotional_weight"])
    asked = ranking.slate_page(ranking.rank_pool(pool(cat, requests(spark, dict(avoid_heavy=False, attention_demand="easy", emotional_weight="")))))
    assert slates.outlier_of_three(asked).first().dimensions == ["emotional_weight"]


def test_links(spark):
    url = "https://a/?mode=decision&v=v4&m=funny&s=nope&f=g%3Da%2Cb%7Cr%3Dshort&d=dh%3D1&ds="
    links = spark.createDataFrame(
        [(1, url + "ts%3Am1%3Bm2%3Bm3"), (2, url + "ts:m1;m2;m9"), (3, url + "dl:m1;m2;cd;m3#x"), (4, url.replace("short", "tiny") + "pk:m1"), (5, url + "pk:m1;duel;dl:m1;m2"), (6, url + "ts:m1;m2;m3;dc;m9")],
        "link_id int, url string",
    )
    known = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "id string")
    got = {r.link_id: r for r in slates.decode_links(links, known).collect()}
    assert sorted(got) == [1, 3, 5]
    assert (got[1].genres, got[1].runtime, got[1].situation, got[1].avoid_heavy) == ("a|b", "short", None, True)
    assert (got[3].kind, got[3].ids, got[5].ids) == ("dl", "m1|m2|m3", "m1|m1|m2")


def test_axis_heads_are_cut_without_sorting_the_groups(spark):
    """Null orders come first, equal ones stay, small and null groups keep all their rows, and few others are left to sort."""
    from curatorium.plans.requests import _near_the_first

    rows = [("big", "x", i, f"i{i}") for i in range(5000)] + [("big", None, None if i == 7 else i, f"n{i}") for i in range(3000)] + [("few", "y", i, f"f{i}") for i in range(2)] + [("same", "z", 5, f"s{i}") for i in range(9)]
    found = _near_the_first(spark.createDataFrame(rows, "mood string, value string, ord long, id string"), ["mood", "value"], "ord", "id", 3)
    got = {}
    for r in found.collect():
        got.setdefault((r.mood, r.value), set()).add(r.id)
    assert got[("big", "x")] >= {"i0", "i1", "i2"} and got[("big", None)] >= {"n7", "n0", "n1"}
    assert got[("few", "y")] == {"f0", "f1"} and len(got[("same", "z")]) == 9
    assert len(got[("big", "x")]) + len(got[("big", None)]) < 40
