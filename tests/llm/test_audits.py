"""Source divergence and filter interactions: SQL over the tables, brute force over awkward rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from fixtures import SF, edge, edge_rows, words

from curatorium.llm import divergence, filteraudit, registry, store
from tools.check import compare, connect

registry.load_all()
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, rank int, part string"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_filter_interactions"])
def test_query_equals_sql(spark, name):
    status, _, _, detail = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert status == "OK", detail


def plain_divergence(rows):
    """(lang, source, part, item, value, rank) by comparing every pair of sources term by term."""
    df, total, own, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
        df[lang].update(set(terms))
        own[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        share = lambda counts, n: {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}
        size = lambda counts: sum(counts[t] for t in kept)
        p = {s: share(own[lang, s], size(own[lang, s])) for s in names}
        whole = sum((own[lang, s] for s in names), Counter())
        q = share(whole, size(whole))
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def _groups():
    rng = np.random.default_rng(9)
    vocabulary = [f"wort{'äß'[i % 2]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["日本", "😀x", "The"]
    rows = []
    for i in range(160):
        draws = rng.zipf(1.3, size=rng.integers(0, 60))
        text = " ".join(vocabulary[d % len(vocabulary)].upper() if d % 7 == 0 else vocabulary[d % len(vocabulary)] for d in draws)
        rows.append((i, text, [None, "", "de", "fr"][i % 4], [None, "s1", "s2", "s3", "sé"][i % 5], "x", 1, "p"))
    rows += [(900, None, "de", "empty", None, None, None), (901, "12 34", "de", "digits", None, None, None), (902, "alone", "xx", "one", None, None, None), (903, "alone", "xx", "two", None, None, None)]
    rows += [(7, "Repeated repeated", "yy", "a", None, None, None)] * 3 + [(8, "A" * 3000 + " repeated", "yy", "b", None, None, None)]
    return rows


def test_divergence_equals_all_pairs_of_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_CELLS", 64)
    store.ship(spark)
    rows = _groups()
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_divergence([r[1:4] for r in rows])


def test_divergence_of_awkward_rows(spark):
    store.ship(spark)
    got = divergence.source_divergence(edge(spark)).collect()
    assert sorted(map(tuple, got)) == plain_divergence([r[1:4] for r in edge_rows()])
    assert divergence.source_divergence(edge(spark).limit(0)).count() == 0


def test_texts_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    data = "aaaa bbbbbbbbbbbbbbb cc 12345678901234 dd ééééééé x".encode()
    assert b"".join(divergence._pieces(data)) == data
    assert [t for p in divergence._pieces(data) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(data)


def test_full_dictionaries_are_written_out(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = _groups()
    store.ship(spark)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": (r[2] or "").encode(), "source": (r[3] or "").encode(), "text": (r[1] or "").encode()} for r in rows])
    found = list(divergence._count(iter([batch])))
    total = Counter()
    for b in found:
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for r in rows:
        want.update(((r[2] or "").encode(), (r[3] or "").encode(), t) for t in divergence.TERM.findall((r[1] or "").encode().lower()))
    assert len(found) > 5 and +total == want


def plain_interactions(docs, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        rules = [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        ]
        fails.append((i, source or "", {c for c, r in zip("ABCDE", rules) if r}))
    out = {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone, stay = [x for x in left if c in x[1]], [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                redundant = sum(c in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c]
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return sorted((*k, *v) for k, v in out.items())


def test_interactions_equal_plain_filters(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long, long + " #", long.upper(), "a b", "a b", "", None, "a " * 400, long, "x|y " * 300, None]
    docs = [(i if i != 5 else None, t, [None, "", "s1", "s2"][i % 4], "x", "y", 1, "z") for i, t in enumerate(texts)] + [(0, long, "s9", None, None, None, None), (0, long, "s9", None, None, None, None)]
    docs = [(i, t, "en", s, k, r, p) for i, t, s, k, _, r, p in docs]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (3, None, 1), (4, 1, 1), (None, 1, 1), (8, 1, 0), (9, 0, 0)]
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filteraudit.interactions(frame, marks).select(*columns).collect()
    assert sorted(map(tuple, got)) == plain_interactions([(d[0], d[1], d[3]) for d in docs], labels)
    assert filteraudit.interactions(frame.limit(0), marks).count() == 0
    assert filteraudit.interactions(frame, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_interactions_of_awkward_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filteraudit.interactions(edge(spark), marks).collect()
    want = plain_interactions([(r[0], r[1], r[3]) for r in edge_rows()], [])
    assert sorted(map(tuple, got)) == want and len(words("a b")) == 2


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        ranks = sorted(r for m, _, _, lo, hi in filteraudit.INTERVALS if m == mask for r in range(lo, hi))
        assert ranks == list(range(filteraudit.ORDERS))
        for m, step, f, lo, _ in filteraudit.INTERVALS:
            order = list(permutations(range(5)))[lo]
            assert order[step - 1] == f and (m != mask or not any(mask >> g & 1 for g in order[: step - 1]))
