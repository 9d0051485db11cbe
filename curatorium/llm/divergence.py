"""Source divergence audit: term probabilities of the sources of a language compared by count-level bitmaps.

1. ``term_counts``: one pass counts terms and the documents that hold them per (lang, source), in bounded dictionaries that
   are written out when full; sums per (lang, source, term) follow, added up before the shuffle.
2. A language keeps the V terms of at least three of its documents.  With N occurrences of kept terms in a group, a term
   with ``count`` of them there has p = 1 + floor(10^9 * (count + 1) / (N + V)), so p depends on the group and the count only.
3. ``pair_values``: kept terms are dealt into chunks of like frequency.  Inside a chunk, 64 terms at a time, each (group,
   count) that occurs has a bitset of its terms, and the terms that a group lacks are the complement of its bitsets.  AND and
   popcount of two bitsets give the number of terms with that pair of counts; it is multiplied by f(p, q) and summed per
   pair of groups.  No row per term and pair of groups is ever made.
4. ``term_values`` compares each group with its whole language term by term.

A hot source or language spreads over the chunks; a task holds one chunk (some ``CHUNK_CELLS`` counts) and one number per
pair of groups of a language, as many as its result has rows.  Arithmetic is on integers: 64 bits where 10^18 bounds the
values, decimals beyond.

Defined cases: null text, lang or source count as ''; a group without terms is compared with p of count 0; a language
without kept terms has value 0 for all pairs and no terms; rows that repeat count each, also as documents; terms are byte
strings and compared as such; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import settle

#: Runs of letters: ASCII letters and every character beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Entries of a worker's dictionaries, bytes of text matched at a time, counts in a chunk, bitset pairs compared at a time.
HELD, PIECE, CHUNK_CELLS, PAIRS = 1 << 18, 1 << 20, 1 << 17, 1 << 19


def _pieces(data: bytes):
    """``data`` in parts of about ``PIECE`` bytes that end between terms."""
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        inside = TERM.match(data, cut)
        cut = inside.end() if inside else cut
        yield data[at:cut]
        at = cut
    yield data[at:]


def _count(batches):
    found: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        groups, terms, counts, docs = [], [], [], []
        for group, (n, df) in found.items():
            groups += [group] * len(n)
            terms += n.keys()
            counts += n.values()
            docs += map(df.__getitem__, n)
        langs, sources = ([g[k] for g in groups] for k in (0, 1))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), pa.array(sources, pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            group = (lang.as_py(), source.as_py())
            if group not in found:
                found[group] = Counter({b"": 0}), Counter()  # the empty term stands for the group itself
            n, df = found[group]
            before, seen = len(n), set()
            for piece in _pieces(text.as_py().lower()):  # of bytes, only A-Z
                terms = TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            held += len(n) - before
            if held > HELD:
                yield flush()
                held = 0
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), and a row with the term '' and n = 0 for every group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_count, "lang binary, source binary, term binary, n long, docs long")
    counted = counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact also where the product passes 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", (count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), total + terms)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def model(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tables (groups, chunks) and the cells over them.

    groups: lang, lang_id, source, gid, total, n_terms (V of the lang), zero (p of a count of 0; null without terms);
    chunks: chunk, lang; cells: a row per group and kept term that it has, with gid, lang_id, term, n, p, and of the term
    term_key, all (its occurrences in the lang), chunk and q.  Terms travel with their counts once; later steps need no join
    on them.
    """
    counts = settle(term_counts(docs), "term-counts")
    own = counts.where("term <> ''")
    terms = own.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("held")).where(F.col("docs") >= least)
    # chunks of one order of magnitude of frequency, some CHUNK_CELLS counts each; terms of one chunk share few counts otherwise
    terms = settle(terms.drop("docs").withColumn("class", F.floor(F.log2("all")).cast("int")).withColumn("term_key", F.monotonically_increasing_id()), "terms")
    langs = terms.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    langs = settle(counts.where("term = ''").select("lang").distinct().withColumn("lang_id", F.monotonically_increasing_id()).join(langs, "lang", "left"), "langs")
    sizes = terms.groupBy("lang", "class").agg(F.ceil(F.sum("held") / CHUNK_CELLS).cast("long").alias("chunks"))
    chunk = F.xxhash64("lang", "class", F.pmod(F.xxhash64("term"), F.col("chunks")))
    placed = terms.join(sizes, ["lang", "class"]).join(langs, "lang")
    placed = placed.select("lang", "term", "term_key", "all", chunk.alias("chunk"), probability(F.col("all"), F.col("lang_total"), F.col("n_terms")).alias("q"))
    kept = settle(own.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").withColumn("gid", F.monotonically_increasing_id())
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = groups.withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    zero = F.when(F.col("n_terms") > 0, probability(F.lit(0), F.col("total"), F.greatest("n_terms", F.lit(1))))
    groups = settle(groups.select("lang", "lang_id", "source", "gid", "total", "n_terms", zero.alias("zero")), "groups")
    cells = kept.join(groups, ["lang", "source"])
    cells = cells.select("lang_id", "gid", "term", "term_key", "all", "chunk", "n", "q", probability(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    return groups, settle(kept.select("chunk", "lang").distinct(), "chunks"), cells


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p[:, None] - q) ** 2 // q


def _bitsets(term: np.ndarray, gid: np.ndarray, n: np.ndarray, p: np.ndarray, groups: np.ndarray, zeros: np.ndarray):
    """(gid, p, bits, starts) of the count levels of at most 64 terms, by group; each group's first level is its complement."""
    full = np.uint64((1 << (int(term.max()) + 1)) - 1)
    order = np.lexsort((n, gid))
    term, gid, n, p = term[order], gid[order], n[order], p[order]
    opens = np.flatnonzero(np.concatenate(([True], (gid[1:] != gid[:-1]) | (n[1:] != n[:-1]))))
    bits = np.bitwise_or.reduceat(np.uint64(1) << term.astype(np.uint64), opens)
    held = np.zeros(len(groups), np.uint64)
    np.bitwise_or.at(held, np.searchsorted(groups, gid[opens]), bits)
    gids = np.concatenate((groups, gid[opens]))
    values, sets = np.concatenate((zeros, p[opens])), np.concatenate((full & ~held, bits))
    order = np.argsort(gids, kind="stable")
    gids = gids[order]
    return values[order], sets[order], np.searchsorted(gids, groups)


def _joint(sums: np.ndarray, p: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> None:
    """Adds f(p, q) times the terms shared by each pair of levels to ``sums`` (groups by groups)."""
    step = max(1, PAIRS // len(p))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
    for at in range(0, len(p), step):
        shared = np.bitwise_count(bits[at : at + step, None] & bits).astype(np.int64)
        cells = np.add.reduceat(shared * _f(p[at : at + step], p), starts, axis=1)
        own = owner[at : at + step]
        opens = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums[own[opens]] += np.add.reduceat(cells, opens, axis=0)


def _pairs(batches):
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for table_ in W.complete_runs(batches, "chunk"):
        col = {c: table_.column(c).to_numpy() for c in ("chunk", "lang_id", "gid", "term_key", "total", "n", "p")}
        # a run of one chunk number holds one chunk, or in the rarest case chunks of several languages; batches hold many runs
        order = np.lexsort((col["gid"], col["term_key"], col["total"], col["lang_id"], col["chunk"]))
        col = {c: v[order] for c, v in col.items()}
        bounds = np.flatnonzero(np.concatenate(([True], (col["chunk"][1:] != col["chunk"][:-1]) | (col["lang_id"][1:] != col["lang_id"][:-1]), [True])))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = {c: v[lo:hi] for c, v in col.items()}
            of_group = part["n"] == 0
            groups, zeros = part["gid"][of_group], part["p"][of_group]
            by = np.argsort(groups)
            groups, zeros = groups[by], zeros[by]
            cell = {c: v[~of_group] for c, v in part.items()}
            lang = int(part["lang_id"][0])
            if lang not in sums:
                sums[lang] = groups, np.zeros((len(groups), len(groups)), np.int64)
            keys = np.flatnonzero(np.concatenate(([True], (cell["term_key"][1:] != cell["term_key"][:-1]) | (cell["total"][1:] != cell["total"][:-1]))))
            number = np.repeat(np.arange(len(keys)), np.diff(np.append(keys, len(cell["n"]))))
            edges = np.append(keys[::64], len(cell["n"]))
            for a, b in zip(edges[:-1], edges[1:]):
                _joint(sums[lang][1], *_bitsets(number[a:b] % 64, cell["gid"][a:b], cell["n"][a:b], cell["p"][a:b], groups, zeros))
    for lang, (groups, values) in sums.items():
        for at in range(0, len(groups), step := max(1, (1 << 16) // len(groups))):
            rows = groups[at : at + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, len(groups))), pa.array(np.tile(groups, len(rows))), pa.array(values[at : at + step].ravel())], ["a", "b", "value"])


def pair_values(groups: DataFrame, chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, value) for the groups a and b of a language with kept terms: f summed over its kept terms."""
    rows = cells.select("chunk", "lang_id", "gid", "term_key", F.col("all").alias("total"), "n", "p")
    none = F.lit(0).cast("long")
    zero = chunks.join(groups, "lang").select("chunk", "lang_id", "gid", F.lit(-1).cast("long").alias("term_key"), none.alias("total"), none.alias("n"), F.col("zero").alias("p"))
    dealt = rows.unionByName(zero).repartition("chunk").sortWithinPartitions("chunk")
    found = dealt.mapInArrow(_pairs, "a long, b long, value long").where("a <> b")
    return found.groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def term_values(cells: DataFrame, ranks: int | None = TERM_RANKS) -> DataFrame:
    """(gid, item, value, rank): the kept terms that a group uses more than its language."""
    found = cells.where("p > q").select("gid", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found, ranks)


def _ranked(rows: DataFrame, ranks: int | None = None) -> DataFrame:
    order = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if ranks is None else ranked.where(F.col("rank") <= ranks)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int | None = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source)."""
    groups, chunks, cells = model(docs, least)
    names = groups.select("lang", "source", "gid")
    values = pair_values(groups, chunks, cells)
    other = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"))
    pairs = names.withColumnRenamed("gid", "a").join(other, "lang").where("a <> b").join(values, ["a", "b"], "left")
    pairs = _ranked(pairs.select(F.col("a").alias("gid"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    found = pairs.withColumn("part", F.lit("pair")).unionByName(term_values(cells, ranks).withColumn("part", F.lit("term")))
    return found.join(names, "gid").select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (gn.total + v.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000 * CAST(k.n + 1 AS HUGEINT)) // (v.total + v.v) AS HUGEINT) AS q
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", ORACLE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
