"""Title resolution: redirect chains, containment and scores against plain versions."""

import random

from curatorium.operators import titles as N


def test_redirects_end_whatever_their_length(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    loops = [("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("into", "l1"), ("far", "into")]
    others = [("a", "b"), ("a", "a0"), ("s", "s"), (None, "x"), ("y", None)]
    got = {r.source: (r.final, r.hops) for r in N.redirect_ends(spark.createDataFrame(chain + loops + others, "source string, target string")).collect()}
    want = {f"c{i}": ("c37", 37 - i) for i in range(37)} | {k: (None, None) for k in ("l0", "l1", "l2", "into", "far")} | {"a": ("a0", 1)}
    assert got == want
    assert N.redirect_ends(spark.createDataFrame([], "source string, target string")).count() == 0


def test_containment_equals_every_pair(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(300)] + ["thethe", "日本語版", None, ""]
    needles = [word(rng.randrange(0, 9)) for _ in range(150)] + ["the", "日本", "本", "", None, "zzz", "abcabcabz"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    found = N.containing(frame(needles, "n"), frame(texts, "t"), "n", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    want = sorted({(n, t) for n in needles for t in texts if n and t and n in t})
    assert sorted(tuple(r) for r in found.collect()) == want


def test_scores_and_ambiguity(spark):
    facts = [(1, "Up", 2009), (2, "Heat", 1995), (3, "The Thing", 1982), (4, "Twin", 2000), (5, "Nothing like it", 1999), (6, "!?", 1990), (7, "Solaris", 1972)]
    pages = [
        ("Up (2009 film)", False, 10), ("Up", True, 90), ("Pick Up (1959 film)", False, 60), ("HEAT (film)", False, 0), ("Heat", False, 30), ("The-Thing (1982 Film)", False, 0),
        ("Twin (film)", False, 20), ("Twin", False, 40), ("Солярис", False, 70), ("Solaris (novel)", False, 10), ("?!", False, 90),
    ]
    redirects = [("Solaris (1972 film)", "Солярис"), ("Nothing like it (film)", "Nowhere")]
    found = N.resolve_titles(
        spark.createDataFrame(facts, "id long, title string, year int"), spark.createDataFrame(pages, "page_title string, disambiguation boolean, structure_score int"),
        spark.createDataFrame(redirects, "source string, target string"),
    )
    got = {r.id: (r.page_title, r.score, r.path) for r in found.collect()}
    assert got[1] == ("Up (2009 film)", 140, ["Up (2009 film)"])
    assert got[2] == ("Heat", 90, ["Heat"])
    assert got[3] == ("The-Thing (1982 Film)", 130, ["The Thing (1982 film)"])
    assert got[4] == (None, 100, None)  # two pages with the best score
    assert got[5] == (None, None, None)
    # a page in another script is reached by its redirect; titles without letters or digits meet as they are
    assert got[7] == (None, 70, None) and got[6] == (None, None, None)
