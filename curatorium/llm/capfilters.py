"""Near-duplicate groups of embeddings by spherical-cap filters.

1. Equal vectors of a label are one class; everything later works on classes.
2. ``decode``: unit vectors are rotated at random and cut into two halves.  Each half has a codebook of random unit vectors;
   the filter directions are all pairs of codewords, so their number is the square of a codebook's.  A vector lies in every
   cap whose direction exceeds its own bound, the widest that holds ``CAP`` directions: these are listed from the sorted
   inner products of the halves without a look at the other directions.  The code grows with the rows of the largest label,
   so that a cap holds few strangers at any size.
3. Classes that share a filter of their label are candidates.  Each class goes to one home, the smallest class among the
   first members of its filters that a 256-bit sketch of signs finds near; groups of near copies thus have one home.  All
   pairs of a home meet in blocks of ``BLOCK_ROWS``, each vector sent once per pair of blocks.
4. Pairs with different homes meet in the first filter that they share: sketches are compared there first, and only pairs
   that the sketch can't rule out are compared as vectors.  Hot filters are cut into blocks as well; no row per pair is
   written anywhere, and nothing is capped.
5. Every pair is compared once, by cosine in double precision.  Counts of links are added up; a spanning forest of each block
   leads to the components.

At cosine 0.98, 24 directions of a million have 15 in common on average, with none in fewer than one pair of 10^4; closer
pairs share more.  The sketch differs in 16 bits there on average, with a deviation of 3.9; pairs beyond 44 are dropped.

Defined cases: rows whose label or vector is null, empty, zero or holds null or non-finite components have no links and are
their own component; vectors of different lengths have no cosine and are not linked; rows without vec_id count as vectors,
and their component_id is the smallest id reachable (null if none); rows that share a vec_id are separate vectors; equal
rows link with each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.blocks import group_blocks, meeting_blocks, pairs_within, starts_of
from curatorium.llm.graph import components
from curatorium.llm.registry import query, table
from curatorium.llm.store import settle

THRESHOLD = 0.98
CAP = 24
LEAST_DIMENSIONS = 64  # shorter vectors are filled up with zeros, which changes no cosine
LEAST_CODEWORDS = 256
SKETCH = 256
FAR = 44
BLOCK_ROWS = 2048
#: Numbers of one temporary array.
CELLS = 1 << 20
PAIRS = 1 << 16
SEED = 12


def codewords(rows: int) -> int:
    """Codewords of each half for labels of up to ``rows`` vectors: a power of two, its square at least 128 filters a row."""
    return max(LEAST_CODEWORDS, 1 << int(np.ceil(np.log2(128 * max(rows, 1)) / 2)))


def _units(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _code(dimensions: int, words: int):
    """(rotation, codebook of the first half, of the second, directions of the sketch): drawn from a fixed seed."""
    rng = np.random.default_rng((SEED, dimensions, words))
    rotation, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
    half = dimensions // 2
    return rotation, _units(rng.standard_normal((words, half))), _units(rng.standard_normal((words, dimensions - half))), rng.standard_normal((dimensions, SKETCH))


#: Ranks (i, j) of two sorted lists whose sum can be among the CAP largest: (i + 1) * (j + 1) - 1 sums are at least as large.
_STAIRS = np.array([(i, j) for i in range(CAP) for j in range(CAP) if (i + 1) * (j + 1) <= CAP]).T


def _largest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the CAP largest of each row, descending."""
    at = np.argpartition(-values, CAP - 1, axis=1)[:, :CAP]
    found = np.take_along_axis(values, at, axis=1)
    order = np.argsort(-found, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(found, order, axis=1)


def unit_vectors(column, dimensions: int) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return _units(values / np.abs(values).max(axis=1, keepdims=True))  # no square leaves the range of doubles


def decode(vectors: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters, first, sketches) of unit vectors: the directions of each one's cap, ascending, and the signs as 64-bit words."""
    dimensions = max(vectors.shape[1], LEAST_DIMENSIONS)
    rotation, left, right, signs = _code(dimensions, words)
    step = max(1, CELLS // words)
    filters, counts, sketches = [], [], []
    for at in range(0, len(vectors), step):
        some = vectors[at : at + step]
        turned = np.pad(some, ((0, 0), (0, dimensions - some.shape[1]))) @ rotation
        half = dimensions // 2
        a_at, a = _largest(turned[:, :half] @ left.T)
        b_at, b = _largest(turned[:, half:] @ right.T)
        i, j = _STAIRS
        sums = a[:, i] + b[:, j]
        bound = np.partition(sums, sums.shape[1] - CAP, axis=1)[:, sums.shape[1] - CAP, None]
        row, stair = np.nonzero(sums >= bound)
        found = a_at[row, i[stair]].astype(np.int64) * words + b_at[row, j[stair]]
        order = np.lexsort((found, row))
        filters.append(found[order])
        counts.append(np.bincount(row, minlength=len(some)))
        sketches.append(np.packbits(turned @ signs > 0, axis=1).view(np.uint64))
    return np.concatenate(filters), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), np.concatenate(sketches)


DECODED = "node long, gid long, dims int, size long, smallest long, s0 long, s1 long, s2 long, s3 long, filters array<long>"


def _decoder(words: int):
    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n in np.unique(dims):
                part = batch.filter(pa.array(dims == n))
                filters, first, sketches = decode(unit_vectors(part.column("embedding"), int(n)), words)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(filters))
                columns = [part.column(c) for c in ("node", "gid", "dims", "size", "smallest")]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(sketches[:, k].view(np.int64)) for k in range(4)], lists, part.column("embedding")], ["node", "gid", "dims", "size", "smallest", "s0", "s1", "s2", "s3", "filters", "embedding"])

    return run


def _comparable() -> Column:
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(values) > 0) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, 4)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, classes) of the comparable rows, written: (label, dims, gid, rows) and a decoded row per distinct vector of a group."""
    sized = vectors.withColumn("dims", F.size("embedding"))
    groups = sized.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("rows"))
    groups = settle(groups.withColumn("gid", F.monotonically_increasing_id()), "label-groups")
    largest = groups.agg(F.max("rows")).first()[0] or 0
    distinct = sized.join(groups, ["label", "dims"]).groupBy("gid", "dims", "embedding").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("smallest"))
    distinct = distinct.withColumn("node", F.monotonically_increasing_id())
    kind = dict(vectors.dtypes)["embedding"]
    return groups, settle(distinct.mapInArrow(_decoder(codewords(largest)), f"{DECODED}, embedding {kind}"), "cap-classes")


def _homes(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, home): the smallest first member of its filters that the sketch finds near, else the class itself."""
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("gid").alias(f"{c}_gid"), *[F.col(f"s{k}").alias(f"{c}{k}") for k in range(4)])
    near = stars.join(side("a"), "a").join(side("b"), "b").where((F.col("a_gid") == F.col("b_gid")) & (_distance("a", "b") <= FAR))
    return near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("home"))


def _likely(batches):
    """Per block row, the nodes of the same pair of blocks with another home that the sketch can't rule out."""
    for table_ in W.complete_runs(batches, "block"):
        col = {c: table_.column(c).to_numpy() for c in ("block", "node", "gid", "label", "tag", "side", "alone")}
        sketches = np.stack([table_.column(f"s{k}").to_numpy().view(np.uint64) for k in range(4)])
        kept_p, kept_q = [], []
        for p, q in pairs_within(starts_of(col["block"]), len(col["node"]), PAIRS):
            ok = (col["label"][p] != col["label"][q]) & (col["gid"][p] == col["gid"][q]) & (col["alone"][p] | (col["side"][p] != col["side"][q]))
            p, q = p[ok], q[ok]
            far = sum(np.bitwise_count(s[p] ^ s[q]).astype(np.int64) for s in sketches)
            kept_p.append(p[far <= FAR].astype(np.int32))
            kept_q.append(q[far <= FAR].astype(np.int32))
        p, q = np.concatenate(kept_p), np.concatenate(kept_q)
        if not len(p):
            continue
        rows = np.unique(np.concatenate((p, q)))
        order = np.argsort(p, kind="stable")
        offsets = np.searchsorted(p[order], np.append(rows, len(col["node"]))).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(col["node"][q[order]]))
        yield pa.RecordBatch.from_arrays([pa.array(col["block"][rows]), pa.array(col["tag"][rows]), pa.array(col["node"][rows]), partners], ["block", "tag", "node", "partners"])


def _found(nodes: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b, links): the links counted for a, and the root b of its component in the block."""
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[roots[some]]), pa.array(links[some])], ["a", "b", "links"])


def _home_links(batches):
    """Links of all pairs of each block: one side with itself, or two sides with each other."""
    for table_ in W.complete_runs(batches, "block"):
        blocks = table_.column("block").to_numpy()
        bounds = np.append(starts_of(blocks), len(blocks))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = table_.slice(lo, hi - lo)
            nodes, sizes, side = (part.column(c).to_numpy() for c in ("node", "size", "side"))
            vectors = unit_vectors(part.column("embedding").combine_chunks(), part.column("dims")[0].as_py())
            n, alone = len(nodes), part.column("alone")[0].as_py()
            linked = np.empty((n, n), bool)
            step = max(1, CELLS // n)
            for at in range(0, n, step):
                linked[at : at + step] = vectors[at : at + step] @ vectors.T >= THRESHOLD
            linked[np.arange(n), np.arange(n)] = False
            if not alone:
                linked &= side[:, None] != side
            links = np.array([int(sizes[row].sum()) for row in linked], np.int64)
            yield _found(nodes, links, _roots_of(linked))


def _roots_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each one's component in a matrix of links."""
    roots = np.full(len(linked), -1)
    for start in range(len(linked)):
        if roots[start] >= 0:
            continue
        roots[start], queue = start, [start]
        while queue:
            fresh = np.flatnonzero(linked[queue.pop()] & (roots < 0))
            roots[fresh] = start
            queue.extend(fresh.tolist())
    return roots


def _first_common(lists: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest value that two rows of ascending lists share."""
    same = (lists[p][:, :, None] == lists[q][:, None, :]).any(axis=2)
    return lists[p, same.argmax(axis=1)]


def _filter_links(batches):
    """Links of the listed pairs whose first common filter is the block's."""
    for table_ in W.complete_runs(batches, "block"):
        blocks = table_.column("block").to_numpy()
        bounds = np.append(starts_of(blocks), len(blocks))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = table_.slice(lo, hi - lo)
            nodes, sizes = part.column("node").to_numpy(), part.column("size").to_numpy()
            tag, gid, dims = (part.column(c).to_numpy() for c in ("tag", "gid", "dims"))
            filters, partners = part.column("filters").combine_chunks(), part.column("partners").combine_chunks()
            widths = filters.value_lengths().to_numpy()
            lists = np.arange(-1, -1 - len(nodes), -1)[:, None].repeat(widths.max(), axis=1)  # fill: equal to no other row's
            lists[np.arange(widths.max()) < widths[:, None]] = filters.flatten().to_numpy()
            own = np.argsort(nodes)
            p = np.repeat(np.arange(len(nodes)), partners.value_lengths().to_numpy())
            q = own[np.searchsorted(nodes, partners.flatten().to_numpy(), sorter=own)]
            links, roots = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            kept_p, kept_q = [], []
            for n in np.unique(dims):
                rows = np.flatnonzero(dims == n)
                vectors = unit_vectors(part.column("embedding").combine_chunks().take(pa.array(rows)), int(n))
                place = np.zeros(len(nodes), np.int64)
                place[rows] = np.arange(len(rows))
                mine = np.flatnonzero((dims[p] == n) & (gid[p] == gid[q]))
                step = max(1, CELLS // max(int(n), int(widths.max()) ** 2))
                for at in range(0, len(mine), step):
                    a, b = p[mine[at : at + step]], q[mine[at : at + step]]
                    ok = np.einsum("ij,ij->i", vectors[place[a]], vectors[place[b]]) >= THRESHOLD
                    a, b = a[ok], b[ok]
                    ok = _first_common(lists, a, b) == tag[a]
                    kept_p.append(a[ok])
                    kept_q.append(b[ok])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_p, kept_q))
            np.add.at(links, a, sizes[b])
            np.add.at(links, b, sizes[a])
            while True:
                before = roots.copy()
                np.minimum.at(roots, a, roots[b])
                np.minimum.at(roots, b, roots[a])
                if (roots == before).all():
                    break
            yield _found(nodes, links, roots)


def link_classes(classes: DataFrame) -> DataFrame:
    """(a, b, links), written: links counted for class a in one block, and a class b that they lead to."""
    members = classes.select("node", "gid", F.explode("filters").alias("tag")).withColumn("key", F.xxhash64("gid", "tag"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("first")).where("rows > 1")
    members = settle(members.join(shared, "key").select("key", "tag", "node", "first"), "cap-members")
    sketches = classes.select("node", "gid", "s0", "s1", "s2", "s3")
    homes = settle(_homes(members, sketches), "homes")

    together = homes.unionByName(homes.select(F.col("home").alias("node")).distinct().join(homes, "node", "left_anti").select("node", F.col("node").alias("home")))
    rows = group_blocks(together.select(F.col("home").alias("key"), "node"), BLOCK_ROWS)
    rows = rows.join(classes.select("node", "size", "dims", "embedding"), "node")
    inside = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_home_links, "a long, b long, links long")

    listed = members.select("key", "tag", "node", F.lit(1).alias("weight"))
    rows = meeting_blocks(listed, homes.select(F.col("node").alias("nid"), F.col("home").alias("label")), BLOCK_ROWS, BLOCK_ROWS)
    rows = rows.join(sketches, "node").drop("weight")
    likely = settle(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_likely, "block long, tag long, node long, partners array<long>"), "likely")
    rows = likely.join(classes.select("node", "gid", "size", "dims", "filters", "embedding"), "node")
    across = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_filter_links, "a long, b long, links long")
    return settle(inside.unionByName(across), "cap-links")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("comparable", _comparable())
    valid = rows.where("comparable").drop("comparable")
    groups, classes = classes_of(valid)
    found = link_classes(classes)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b")).select("node", F.col("label").alias("root"))
    placed = classes.select("node", "gid", "embedding", "size", "smallest").join(counts, "node", "left").join(labels, "node", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("smallest").alias("least"))
    placed = placed.join(least, "root", "left")
    placed = placed.select("gid", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "smallest").alias("component_id"))
    known = valid.withColumn("dims", F.size("embedding")).join(groups.drop("rows"), ["label", "dims"]).join(placed, ["gid", "embedding"]).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("not comparable").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
),
s AS (SELECT rid, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE ok),
l AS (
  SELECT a.rid AS a, b.rid AS b, b.vec_id AS vb FROM s a JOIN s b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
),
r AS (SELECT rid AS a, rid AS b, vec_id AS vb FROM v UNION SELECT r.a, l.b, l.vb FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(vb) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.a = v.rid LEFT JOIN n ON n.a = v.rid
"""


@query("op12_embedding_duplicates", ORACLE)
def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("label")
