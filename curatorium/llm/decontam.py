"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words are lower-cased runs without punctuation at their edges, as 64-bit hashes.  The 3-grams of all test items set
   bits of a fixed-size table (2^25 bits, whatever the benchmark's size); it is broadcast, and one pass over the texts keeps
   the places whose 3-gram hits a set bit, with the words around them, as many as the longest item of such grams needs.
2. Those places meet the items by an equality join on the 3-gram.  An item's grams are ranked by how often the corpus holds
   them.  A copy that reaches the score with at most one edit per ``EDIT_EVERY`` equal words keeps at least t of them
   (``least_shared``), so all but the t - 1 most frequent are seeds: whatever grams such a copy has kept, one is a seed.
   The frequent rest ("which of the") makes a pair only together with a second hit; this finds most copies with more edits.
3. Each (place, item) pair is aligned by Smith-Waterman over words (+2 equal, -1 different, -1 gap), but for those whose
   words in common can't reach the score needed in any order, such as most that share a phrase of common words.  A document
   is contaminated by an item of n words if the best local score reaches n, half of a perfect copy's 2n, and at least that
   of eight equal words (or of the whole item, if shorter).  The score of ``PART_WORDS`` equal words is enough for any item.

Copies that share no 3-gram with the item, such as those with every third word replaced, can't be seeded.

A hot passage makes one join key hot on the side of the places, which adaptive execution splits; every later step works on
one place at a time.  Defined cases: null and empty texts are clean; items of fewer than three words can't be found; equal
items are reported each; rows of the same doc_id and text share their verdict, also where doc_id is null; empty tables give
clean or no rows; other columns pass through, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import name, settle

GRAM = 3
TABLE_BITS = 25
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.5
LEAST_WORDS = 8
PART_WORDS = 20
EDIT_EVERY = 4
REACH_BITS = 20


def _ragged(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _item_words(batches):
    for batch in batches:
        for part in W.slices(batch, "text"):
            words, first = W.plain_words(part.column("text"))
            grams, gram_first = W.ngram_hashes(words, first, GRAM)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), _ragged(words, first), _ragged(grams, gram_first)], ["item_id", "words", "grams"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, grams) of the items long enough to be found; item is unique."""
    coded = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_words, "item_id long, words array<long>, grams array<long>")
    return settle(coded.where(F.size("words") >= GRAM).withColumn("item", F.monotonically_increasing_id()), "items")


def gram_table(items: DataFrame) -> np.ndarray:
    """Bit table of the items' 3-grams; at most 2^TABLE_BITS / 64 numbers reach the driver."""
    slot = F.shiftrightunsigned("gram", 64 - TABLE_BITS)
    bits = items.select(F.explode("grams").alias("gram")).select(slot.alias("slot")).distinct()
    words = bits.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def least_score(words: Column) -> Column:
    """The score that an item of so many words needs."""
    return F.least(F.greatest(F.ceil(SHARE * MATCH * words), F.least(F.lit(LEAST_WORDS), words) * MATCH), F.lit(PART_WORDS * MATCH)).cast("long")


def least_shared(score: Column) -> Column:
    """Grams that a part of this score keeps at least, with one edit per EDIT_EVERY equal words: m equal words in e + 1 runs
    hold m - (GRAM - 1) * (e + 1) grams, where e = m / EDIT_EVERY and MATCH * m - e reaches the score."""
    equal = F.ceil(score / (MATCH - 1 / EDIT_EVERY))
    return F.greatest(equal - (GRAM - 1) * (F.floor(equal / EDIT_EVERY) + 1), F.lit(1)).cast("long")


def _needed_around(words: Column) -> Column:
    """Words on either side of a hit that an alignment with an item of so many words may use."""
    return words + (words / 4).cast("int") + 8


def reach_table(items: DataFrame) -> np.ndarray:
    """Per leading bits of a gram, the logarithm of the words around it that the items with such grams need."""
    slot = F.shiftrightunsigned(F.col("gram"), 64 - REACH_BITS)
    grams = items.select(F.explode("grams").alias("gram"), F.ceil(F.log2(_needed_around(F.size("words")))).cast("int").alias("need"))
    rows = grams.groupBy(slot.alias("at")).agg(F.max("need").alias("need")).toPandas()  # at most 2^REACH_BITS numbers
    out = np.zeros(1 << REACH_BITS, np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["need"].to_numpy(np.uint8)
    return out


def _places(tables):
    def run(batches):
        table_, reach_of = tables.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, first = W.plain_words(part.column("text"))
                grams, gram_first = W.ngram_hashes(words, first, GRAM)
                slots = grams >> np.uint64(64 - TABLE_BITS)
                hits = np.flatnonzero((table_[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1))
                if not len(hits):
                    continue
                row = np.searchsorted(gram_first, hits, side="right") - 1
                word_at = hits - gram_first[row] + first[row]
                reach = np.int64(1) << reach_of[(grams[hits] >> np.uint64(64 - REACH_BITS)).astype(np.int64)].astype(np.int64)
                begin, end = np.maximum(word_at - reach, first[row]), np.minimum(word_at + GRAM + reach, first[row + 1])
                # hits whose surroundings touch share one place
                order = np.argsort(begin, kind="stable")
                upto = np.maximum.accumulate(end[order])
                opens = np.flatnonzero(np.concatenate(([True], begin[order][1:] >= upto[:-1])))
                lo, hi = begin[order][opens], upto[np.append(opens[1:], len(order)) - 1]
                place = np.searchsorted(lo, word_at, side="right") - 1
                sizes = hi - lo
                starts = np.concatenate(([0], np.cumsum(sizes)))
                around = words[np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(lo, sizes)]
                offsets = np.searchsorted(place, np.arange(len(lo) + 1))
                take = pa.array(row[offsets[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_key").take(take), _ragged(around, starts), _ragged(grams[hits], offsets), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((word_at - lo[place]).astype(np.int32)))],
                    ["doc_id", "text_key", "words", "grams", "at"],
                )

    return run


def _most(left, left_at, right, right_at) -> np.ndarray:
    """An upper bound of each pair's score: the words of either side that the other one has, all aligned."""
    counts = []
    keys = [(words.view(np.uint64) ^ np.repeat(np.arange(len(at) - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.diff(at)), at) for words, at in ((left, left_at), (right, right_at))]
    for (own, at), (other, _) in (keys, keys[::-1]):
        counts.append(np.diff(np.concatenate(([0], np.cumsum(np.isin(own, other))))[at]))
    return MATCH * np.minimum(*counts)


def _best_scores(batches):
    """Adds the best local score to rows of (words, item_words) that may reach ``least``: one row of the alignment of all pairs at a time."""
    for batch in batches:
        text, item = batch.column("words"), batch.column("item_words")
        at = [np.concatenate(([0], np.cumsum(side.value_lengths().to_numpy()))) for side in (text, item)]
        batch = batch.filter(pa.array(_most(text.flatten().to_numpy(), at[0], item.flatten().to_numpy(), at[1]) >= batch.column("least").to_numpy()))
        text, item = batch.column("words"), batch.column("item_words")
        left, right = text.flatten().to_numpy(), item.flatten().to_numpy()
        left_at = np.concatenate(([0], np.cumsum(text.value_lengths().to_numpy())))
        right_at = np.concatenate(([0], np.cumsum(item.value_lengths().to_numpy())))
        n, m = np.diff(left_at), np.diff(right_at)
        scores = np.zeros(len(n), np.int64)
        order = np.lexsort((n, m))
        at = 0
        while at < len(order):
            # pairs of like sizes together, about a million cells of one row
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * n[order[at : stop + 1]].max() <= 1 << 18 and m[order[stop]] <= 2 * m[order[at]] + 8:
                stop += 1
            scores[order[at:stop]] = _align(order[at:stop], left, left_at, n, right, right_at, m)
            at = stop
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_key", "item_id", "n_words", "least")], pa.array(scores)], ["doc_id", "text_key", "item_id", "n_words", "least", "score"])


def _align(rows, left, left_at, n, right, right_at, m) -> np.ndarray:
    wide, tall = int(n[rows].max()), int(m[rows].max())
    grid = np.zeros((len(rows), wide), np.int64)
    inside = np.arange(wide) < n[rows][:, None]
    grid[inside] = np.concatenate([left[left_at[r] : left_at[r + 1]] for r in rows])
    ramp = np.arange(wide) * -GAP
    above = np.zeros((len(rows), wide + 1), np.int64)
    best = np.zeros(len(rows), np.int64)
    for i in range(tall):
        live = i < m[rows]
        word = np.where(live, right[np.minimum(right_at[rows] + i, len(right) - 1)], 0)
        gain = np.where((grid == word[:, None]) & inside & live[:, None], MATCH, MISMATCH)
        now = np.maximum(np.maximum(above[:, :-1] + gain, above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the row
        above[:, 1:] = now
        best = np.maximum(best, np.where(inside & live[:, None], now, 0).max(axis=1))
    return best


def seeds_of(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(item, gram, item_at, seed): every place of every gram of the items, and whether the gram is rare enough to be a seed."""
    grams = items.select("item", F.size("words").alias("n"), F.posexplode("grams").alias("item_at", "gram"))
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    own = grams.groupBy("item", "n", "gram").agg(F.collect_list("item_at").alias("places")).join(often, "gram")
    # places of the item taken up by its most frequent grams, this one included
    upto = F.sum(F.size("places")).over(Window.partitionBy("item").orderBy(F.col("times").desc(), "gram").rowsBetween(Window.unboundedPreceding, 0))
    ranked = own.withColumn("seed", upto >= least_shared(least_score(F.col("n"))))
    return ranked.select("item", "gram", F.explode("places").alias("item_at"), "seed")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_words, score) of every document and item that it contains; text_key is xxhash64 of the text."""
    spark = docs.sparkSession
    items = items_of(benchmark)
    tables = spark.sparkContext.broadcast((gram_table(items), reach_table(items)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    places = keyed.mapInArrow(_places(tables), "doc_id long, text_key long, words array<long>, grams array<long>, at array<int>")
    places = settle(places.withColumn("place", F.monotonically_increasing_id()), "places")

    hits = places.select("place", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("at").alias("at"))))
    pairs = hits.join(seeds_of(items, hits), "gram").groupBy("place", "item")
    pairs = pairs.agg(F.min(F.col("at") - F.col("item_at")).alias("lo"), F.max(F.col("at") - F.col("item_at")).alias("hi"), F.bool_or("seed").alias("seeded"), F.count(F.lit(1)).alias("hits"))
    pairs = pairs.where(F.col("seeded") | (F.col("hits") > 1)).select("place", "item", "lo", "hi")
    n = F.size("item_words")
    slack = (n / 4).cast("int") + 8
    met = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(places.select("place", "doc_id", "text_key", "words"), "place")
    start = F.greatest(F.col("lo") - slack, F.lit(0))
    met = met.select("doc_id", "text_key", "item_id", n.cast("long").alias("n_words"), least_score(n).alias("least"), F.slice("words", start + 1, F.col("hi") + n + slack - start).alias("words"), "item_words")
    scored = met.mapInArrow(_best_scores, "doc_id long, text_key long, item_id long, n_words long, least long, score long").where("score >= least")
    return scored.groupBy("doc_id", "text_key", "item_id", "n_words").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with contaminated, n_items and best_item, the item with the greatest share of its perfect score."""
    found = contamination(docs, benchmark, text)
    rank = F.struct((F.col("score") / F.col("n_words")).alias("share"), -F.col("item_id"), "item_id")
    worst = found.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(
        F.count_distinct("item_id").alias("__n"), F.max(rank).alias("__best")
    )
    joined = docs.join(worst, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__key")), "left")
    return joined.select(
        *[docs[name(c)] for c in docs.columns if c.lower() not in ("contaminated", "n_items", "best_item", "best_share")],
        F.col("__n").isNotNull().alias("contaminated"),
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_items"),
        F.col("__best.item_id").alias("best_item"),
        F.round(F.col("__best.share") / MATCH, 4).alias("best_share"),
    )


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents of the whole table, each with every test item it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    share = F.round(F.max("score") / (MATCH * F.first("n_words")), 4)
    return found.groupBy("doc_id", "item_id").agg(F.first("n_words").alias("n_words"), F.max("score").alias("score"), share.alias("share"))
