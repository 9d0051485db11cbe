"""b-bit MinHash groups against all pairs."""

import random

import tracemalloc

import numpy as np
import pyarrow as pa
from fixtures import EDGE, SF, edge, near_duplicate_classes, shingle_set

from curatorium.llm import graph, neardup, store


def _classes(df):
    store.ship(df.sparkSession)
    return {r["doc_id"]: r for r in neardup.near_duplicates(df).collect() if r["doc_id"] is not None}


def test_tables_equal_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = _classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = near_duplicate_classes(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingle_set(t)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_awkward_rows(spark):
    df = neardup.near_duplicates(edge(spark))
    store.ship(spark)
    rows = df.collect()
    assert len(rows) == len(EDGE)
    want = near_duplicate_classes([(i, t) for i, t in EDGE if shingle_set(t)])
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(edge(spark).limit(0)).count() == 0


def test_chains_whose_links_avoid_the_first_member(spark, monkeypatch):
    """A family of drifting copies: neighbours are similar, far ones are not; blocks of four rows."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    rows, number = [], 0
    for family in range(6):
        text = [f"w{rng.randrange(10_000)}" for _ in range(120)]
        for _ in range(25):
            rows.append((number, " ".join(text)))
            number += 1
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(120)] = f"w{rng.randrange(10_000)}"
    rng.shuffle(rows)
    rows = [(k * 7 % 1009, t) for k, t in rows]
    got = _classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {i: r["component_id"] for i, r in got.items()} == near_duplicate_classes(rows)


def test_estimate_of_packed_minima():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        estimates = []
        for _ in range(60):
            common = rng.integers(0, 1 << 62, int(1000 * share)).astype(np.uint64)
            sides = [np.concatenate((common, rng.integers(0, 1 << 62, (1000 - len(common)) // 2).astype(np.uint64))) for _ in range(2)]
            a, b = (neardup.pack(neardup.minima(s, np.array([0]))) for s in sides)
            estimates.append((neardup.equal_lanes(a, b)[0] / neardup.PERMUTATIONS - 2.0**-neardup.BITS) / (1 - 2.0**-neardup.BITS))
        assert abs(np.mean(estimates) - share) < 0.03


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partial_labels_never_cross_components(spark):
    rng = random.Random(8)
    edges = [(100 * k + rng.randrange(40), 100 * k + rng.randrange(40)) for k in range(5) for _ in range(60)]
    table = spark.createDataFrame(edges, "a long, b long")
    whole = {r["node"]: r["label"] for r in graph.components(table).collect()}
    partial = {r["node"]: r["label"] for r in graph.components(table, rounds=1).collect()}
    assert whole.keys() == partial.keys()
    assert all(whole[n] == whole[label] for n, label in partial.items())


def _block(rows: int, seed: int) -> pa.RecordBatch:
    """Two halves of near copies with different labels that meet in one block; every pair of the halves passes the estimate."""
    rng = np.random.default_rng(seed)
    mins = np.repeat(rng.integers(0, 1 << 32, (1, neardup.PERMUTATIONS), dtype=np.uint64), rows, axis=0)
    mins[np.arange(rows), rng.integers(4, neardup.PERMUTATIONS, rows)] ^= np.uint64(1)
    column = lambda values, kind: pa.array(np.full(rows, values) if np.isscalar(values) else values, kind)
    half = (np.arange(rows) >= rows // 2).astype(np.int32)
    lists = [neardup._lists(neardup.band_keys(mins).ravel(), neardup.BANDS), neardup._lists(neardup.pack(mins).ravel(), neardup.WORDS)]
    plain = [column(seed, pa.int64()), column(np.arange(rows), pa.int64()), column(half, pa.int64()), column(100, pa.int64()), column(half, pa.int32()), column(False, pa.bool_()), column(0, pa.int32())]
    return pa.RecordBatch.from_arrays([*plain, *lists], ["block", "node", "label", "weight", "side", "alone", "tag", "bands", "packed"])


def test_memory_of_a_block_whose_pairs_all_pass():
    block = _block(2 * neardup.BLOCK_ROWS, 5)
    tracemalloc.start()
    found = list(neardup._survivors(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p) for b in found for p in b.column("partners")) == neardup.BLOCK_ROWS**2
    assert peak < 48 << 20, peak
