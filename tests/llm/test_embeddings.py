"""Cap filters against all pairs."""

import numpy as np
import pytest
from fixtures import SF

from curatorium.llm import capfilters, registry, store
from tools.check import compare, connect

registry.load_all()
SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, dims int, `odd.name` int"


def plain(rows):
    """(vec_id, n_links, component_id) of every row by comparing all pairs."""
    units = []
    for _, e, label, *_ in rows:
        ok = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        v = np.array(e, np.float32).astype(np.float64) if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i].append(j)
                links[j].append(i)
    out, seen = [None] * n, set()
    for start in range(n):
        if start in seen:
            continue
        group, queue = {start}, [start]
        while queue:
            fresh = set(links[queue.pop()]) - group
            group |= fresh
            queue += fresh
        seen |= group
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            out[i] = (rows[i][0], len(links[i]), least)
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    store.ship(spark)
    got = capfilters.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def _turned(rng, v, cosine):
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def _unit(rng, n=64):
    v = rng.standard_normal(n)
    return v / np.linalg.norm(v)


def _row(i, v, label, scale=1.0):
    return (i, [float(x) for x in np.float32(np.asarray(v) * scale)], label, "x", 3, 1)


def test_query_equals_sql(spark):
    status, _, _, detail = compare(spark, connect(SF), "op12_embedding_duplicates", registry.QUERIES["op12_embedding_duplicates"], registry.ORACLES["op12_embedding_duplicates"], SF)
    assert status == "OK", detail


@pytest.mark.parametrize("block", [2048, 16])
def test_families_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(capfilters, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = []
    for family in range(25):
        centre = _unit(rng)
        for k in range(int(rng.integers(1, 12))):
            rows.append(_row(len(rows), _turned(rng, centre, rng.uniform(0.96, 1)), family % 3, 10.0 ** rng.integers(-3, 4)))
    hot = _unit(rng)
    rows += [_row(1000 + i, _turned(rng, hot, 0.9945), 0) for i in range(120)] + [_row(2000 + i, hot, i % 4) for i in range(40)]
    drift = _unit(rng)
    for i in range(40):
        rows.append(_row(3000 - i, drift, 1))
        drift = _turned(rng, drift, 0.985)
    rng.shuffle(order := np.arange(len(rows)))
    rows = [rows[i] for i in order]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    v = _unit(rng)
    rows = [
        _row(1, v, 1), _row(1, v, 1), _row(2, v, None), (3, None, 1, None, None, None), (4, [], 1, None, None, None), _row(5, v * 0, 1), (6, [None, *map(float, v[1:])], 1, None, None, None),
        (7, [float("nan"), *map(float, v[1:])], 1, None, None, None), (8, [float("inf"), *map(float, v[1:])], 1, None, None, None), _row(9, v, 2), _row(10, v[:32], 1), _row(11, 5 * v, 1),
        _row(12, -v, 1), _row(None, v, 1), _row(None, -v, 2), _row(13, v * 1e30, 1), _row(14, v * 1e-30, 1), (15, [1.0], 1, None, None, None), (16, [2.0], 1, None, None, None), (17, [-2.0], 1, None, None, None),
        (18, [1.0, 0.0], 1, None, None, None), (19, [1.0, 0.1], 1, None, None, None), (20, [0.0, -1.0], 1, None, None, None), _row(1, -v, 1), (None, None, None, None, None, None),
    ]
    assert found(spark, rows) == plain(rows)
    store.ship(spark)
    assert capfilters.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    doubles = [(i, [1e200 * x for x in map(float, w)], "a") for i, w in enumerate([v, v, _unit(rng)])]
    assert found(spark, doubles, "vec_id long, embedding array<double>, label string") == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]


@pytest.mark.parametrize("dimensions", [16, 64, 200])
def test_recall_of_pairs_at_the_threshold(dimensions):
    rng = np.random.default_rng(dimensions)
    left = np.array([_unit(rng, dimensions) for _ in range(1500)])
    right = np.array([_turned(rng, v, 0.98) for v in left])
    (a, a_at, s), (b, b_at, t) = (capfilters.decode(x, capfilters.codewords(6000)) for x in (left, right))
    shared = [len(np.intersect1d(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]])) for i in range(len(left))]
    assert np.mean(np.array(shared) > 0) > 0.998
    assert np.bitwise_count(s ^ t).sum(axis=1).max() <= capfilters.FAR
    assert np.diff(a_at).min() >= capfilters.CAP


def test_caps_hold_the_largest_of_all_directions():
    rng = np.random.default_rng(2)
    vectors = np.array([_unit(rng) for _ in range(20)])
    filters, first, _ = capfilters.decode(vectors, 256)
    rotation, left, right, _ = capfilters._code(64, 256)
    turned = vectors @ rotation
    for i, v in enumerate(turned):
        sums = ((left @ v[:32])[:, None] + (right @ v[32:])).ravel()
        assert set(filters[first[i] : first[i + 1]]) == set(np.argsort(-sums)[: capfilters.CAP])
