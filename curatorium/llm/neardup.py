"""Near-duplicate groups by b-bit MinHash.

1. ``signatures``: per text the set of distinct 5-word shingles (64-bit hashes), 128 minima, 32 keys of bands of four
   minima each, and the low ``BITS`` bits of every minimum packed into 64-bit words.  Python works on flat arrays of
   about a megabyte of text at a time.
2. Texts with the same set are one class; everything later works on classes, so exact copies cost one narrow row.
3. A bucket is a band key shared by two classes or more.  Every class is compared with the first one of its buckets
   (a star, not all pairs): estimate from the packed bits first, then the full sets.  Most groups become one component.
4. What is left are pairs of one bucket whose components still differ.  Buckets are cut into blocks by hash, apart for the
   most frequent component and the rest, and pairs of blocks with a member of the rest are compared inside one task:
   labels, sizes, the estimate, and only where a pair first shares a band.  The survivors' sets are joined once per block
   and compared.  A task holds two blocks whatever the size of the bucket, and no row per pair is ever written.  Nothing is
   capped: every pair of a bucket is in one component or compared.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.  The estimate
(matching share - 2^-BITS) / (1 - 2^-BITS) has a standard error of about 0.04 there; pairs are dropped five of them below.
Links are decided on the full sets: 100 * intersection >= 75 * union.

Defined cases: null or blank texts have an empty set, are linked with nothing and kept; fewer than five words are one
shingle; rows with the same doc_id and different texts are separate nodes; a row without doc_id keeps its count, has a null
component_id and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.blocks import meeting_blocks, pairs_within, starts_of
from curatorium.llm.graph import components
from curatorium.llm.registry import query, table
from curatorium.llm.store import settle

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
LANES = 64 // BITS
WORDS = PERMUTATIONS // LANES
THRESHOLD = 75  # per cent
STANDARD_ERROR = 0.04
CUT = THRESHOLD / 100 - 5 * STANDARD_ERROR
#: Fewest equal lanes of a pair that passes the estimate.
LEAST_EQUAL = int(np.ceil(PERMUTATIONS * (CUT * (1 - 2.0**-BITS) + 2.0**-BITS)))
ONES = sum(1 << (BITS * i) for i in range(LANES))
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
FILTER_BITS = 20
#: Pairs of a block that are compared at a time: 4 MB of packed minima a side.
PAIRS = 1 << 16

_RNG = np.random.default_rng(77)
_FACTORS = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _RNG.integers(1, 1 << 63, BANDS, dtype=np.uint64)

SIGNATURE = "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, bands array<long>, packed array<long>"


def shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the distinct shingles of each text, ascending."""
    raw, offsets = W.utf8_of(texts)
    raw = W.lower_ascii(raw)
    starts, ends, first = W.word_bounds(raw, offsets)
    return W.distinct_sorted(*W.ngram_hashes(W.span_hashes(raw, starts, ends), first, SHINGLE))


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) smallest value of each permutation over each non-empty run."""
    out = np.empty((len(starts), PERMUTATIONS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat((hashes * factor) >> np.uint64(32), starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    grouped = mins.reshape(len(mins), BANDS, ROWS)
    sums = np.zeros((len(mins), BANDS), np.uint64)
    for k in range(ROWS):
        sums += grouped[:, :, k] * W.LANES[k]
    return W.mix(sums + _BAND_SEEDS)


def pack(mins: np.ndarray) -> np.ndarray:
    """Low BITS bits of every minimum, LANES of them to a 64-bit word."""
    low = W.mix(mins) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(mins), WORDS, LANES) << shifts, axis=2)


def equal_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many packed minima of two arrays of signatures agree, by counting bits."""
    x = a ^ b
    for step in (1, 2):
        x |= x >> np.uint64(step)
    return PERMUTATIONS - np.bitwise_count(x & np.uint64(ONES)).sum(axis=1).astype(np.int64)


def _fingerprints(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.add.reduceat(W.mix(hashes), starts)
    two = np.add.reduceat(W.mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts)
    return one.view(np.int64), two.view(np.int64)


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat.view(np.int64)))


def _sign(batches):
    for batch in batches:
        for part in W.slices(batch, "text"):
            hashes, first = shingles(part.column("text"))
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            n = len(counts)
            fp1, fp2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, WORDS), np.uint64)
            if len(some):
                starts = first[some]
                fp1[some], fp2[some] = _fingerprints(hashes, starts)
                mins = minima(hashes, starts)
                keys[some], packed[some] = band_keys(mins), pack(mins)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(counts.astype(np.int64)), pa.array(fp1), pa.array(fp2), _lists(keys.ravel(), BANDS), _lists(packed.ravel(), WORDS)],
                ["doc_id", "text_key", "n_shingles", "fp1", "fp2", "bands", "packed"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(_sign, SIGNATURE)


def _sets(batches):
    for batch in batches:
        for part in W.slices(batch, "text"):
            hashes, first = shingles(part.column("text"))
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            fp1, fp2 = _fingerprints(hashes, first[some])
            offsets = np.concatenate((first[some], first[-1:])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(some)), pa.array(fp1), pa.array(fp2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))],
                ["doc_id", "fp1", "fp2", "shingles"],
            )


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the given classes (node, doc_id, fp1, fp2), read again from the texts.

    Texts are not shuffled: a semi-join with the slots of the wanted ids, at most 2^FILTER_BITS numbers
    whatever the corpus, drops most others before their sets are built.
    """
    slots = classes.select(_slot().alias("slot")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("slot", _slot())
    texts = texts.join(F.broadcast(slots), "slot", "left_semi").select("doc_id", "text")
    found = texts.mapInArrow(_sets, "doc_id long, fp1 long, fp2 long, shingles array<long>")
    return found.dropDuplicates(["doc_id", "fp1", "fp2"]).join(classes, ["doc_id", "fp1", "fp2"]).select("node", "shingles")


def _sizes_allow(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _estimate_allows(a: str, b: str) -> Column:
    unequal = F.lit(0)
    for i in range(WORDS):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(ONES)))
    return PERMUTATIONS - unequal >= LEAST_EQUAL


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("both") >= THRESHOLD * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _matrix(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _first_shared(bands: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first band in which each pair of rows agrees (BANDS if none), band by band for the pairs still open."""
    found, open_ = np.full(len(p), BANDS), np.arange(len(p))
    for k in range(BANDS):
        same = bands[p[open_], k] == bands[q[open_], k]
        found[open_[same]] = k
        open_ = open_[~same]
    return found


def _survivors(batches):
    """Per block row, the nodes of the same block pair that the estimate can't rule out."""
    for table_ in W.complete_runs(batches, "block"):
        col = {c: table_.column(c).to_numpy() for c in ("block", "node", "label", "weight", "side", "alone", "tag")}
        packed, bands = _matrix(table_.column("packed"), WORDS), _matrix(table_.column("bands"), BANDS)
        kept_p, kept_q = [], []
        for p, q in pairs_within(starts_of(col["block"]), len(packed), PAIRS):
            ok = (col["label"][p] != col["label"][q]) & (col["alone"][p] | (col["side"][p] != col["side"][q]))
            p, q = p[ok], q[ok]
            a, b = col["weight"][p], col["weight"][q]
            ok = 100 * np.minimum(a, b) >= THRESHOLD * np.maximum(a, b)
            p, q = p[ok], q[ok]
            ok = equal_lanes(packed[p], packed[q]) >= LEAST_EQUAL
            p, q = p[ok], q[ok]
            ok = _first_shared(bands, p, q) == col["tag"][p]
            kept_p.append(p[ok].astype(np.int32))
            kept_q.append(q[ok].astype(np.int32))
        p, q = np.concatenate(kept_p), np.concatenate(kept_q)
        if not len(p):
            continue
        rows = np.unique(np.concatenate((p, q)))
        order = np.argsort(p, kind="stable")
        offsets = np.searchsorted(p[order], np.append(rows, len(packed))).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(col["node"][q[order]]))
        yield pa.RecordBatch.from_arrays([pa.array(col["block"][rows]), pa.array(col["node"][rows]), partners], ["block", "node", "partners"])


def _links(batches):
    """A spanning forest of the true links inside each block pair."""
    for table_ in W.complete_runs(batches, "block"):
        blocks, nodes = table_.column("block").to_numpy(), table_.column("node").to_numpy()
        sets, partners = table_.column("shingles").combine_chunks(), table_.column("partners").combine_chunks()
        bounds = np.append(starts_of(blocks), len(blocks))
        out_a, out_b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = {int(v): k for k, v in enumerate(nodes[lo:hi], lo)}
            values = {k: sets[k].values.to_numpy().view(np.uint64) for k in range(lo, hi)}
            parent = {k: k for k in range(lo, hi)}

            def root(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for k in range(lo, hi):
                others = [own[int(v)] for v in partners[k].values.to_numpy() if int(v) in own]
                for start in range(0, len(others), 64):
                    some = [j for j in others[start : start + 64] if root(j) != root(k)]
                    if not some:
                        continue
                    mine = values[k]
                    theirs = np.concatenate([values[j] for j in some])
                    lengths = np.array([len(values[j]) for j in some])
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(lengths) - lengths)
                    for j in np.flatnonzero(100 * both >= THRESHOLD * (len(mine) + lengths - both)):
                        if root(some[j]) != root(k):
                            parent[root(some[j])] = root(k)
                            out_a.append(nodes[k])
                            out_b.append(nodes[some[j]])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set: node, its smallest doc_id, and the signature."""
    same = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("fp1", "fp2")
    found = same.agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "packed")])
    return settle(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label): the component of every class that is linked with another."""
    keyed = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("first")).where("rows > 1")
    members = settle(keyed.join(shared, "key").select("key", "band", "node", "first", "n_shingles"), "members")
    ids = classes.select("node", "doc_id", "fp1", "fp2")
    sizes = classes.select("node", "n_shingles", "packed")

    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    left = sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("packed").alias("pa"))
    right = sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("packed").alias("pb"))
    likely = stars.join(left, "a").join(right, "b").where(_sizes_allow("na", "nb") & _estimate_allows("pa", "pb")).select("a", "b")
    likely = settle(likely, "likely")
    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = settle(sets_of(docs, ids.join(wanted, "node", "left_semi")), "sets")
    stars = settle(_confirmed(likely, sets), "stars")
    labels = components(stars, rounds=2)  # partial labels do: they only spare comparisons

    listed = members.select("key", F.col("band").alias("tag"), "node", F.col("n_shingles").alias("weight"))
    blocks = meeting_blocks(listed, labels.select(F.col("node").alias("nid"), "label"), BLOCK_ROWS, BLOCK_SHINGLES)
    blocks = blocks.join(classes.select("node", "bands", "packed"), "node")
    pairs = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_survivors, "block long, node long, partners array<long>")
    pairs = settle(pairs, "pairs")
    wanted = pairs.select("node").distinct()
    sets = settle(sets_of(docs, ids.join(wanted, "node", "left_semi")), "sets")
    met = pairs.join(sets, "node").repartition("block").sortWithinPartitions("block")
    links = met.mapInArrow(_links, "a long, b long").unionByName(stars)
    return components(settle(links, "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); text_key is xxhash64 of the text."""
    signed = settle(signatures(docs), "signatures")
    classes = classes_of(signed)
    labels = link_classes(docs, classes)
    placed = classes.select("node", "doc_id", "fp1", "fp2").join(labels, "node", "left")
    smallest = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("smallest"))
    placed = placed.join(smallest, "label", "left").select("fp1", "fp2", F.coalesce("smallest", "doc_id").alias("class_id"))
    rows = signed.select("doc_id", "text_key", "n_shingles", "fp1", "fp2").join(placed, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
