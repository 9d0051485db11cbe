"""Language identification: a bidirectional gated recurrent network over bytes labels every position, a document pools them.

A sequence is a word: lower-cased (ASCII and Latin-1), without punctuation at its edges, at most ``LONGEST`` bytes; longer
words go on as further sequences.  The network starts afresh at each word, so equal words have equal labels, and a worker
runs it once per distinct word and remembers the sums, up to a bound.  The probabilities of all positions of the whole text
are averaged; the greatest is the label and the score.

Training is numpy with backpropagation through time and Adam, on a bounded sample that Spark draws: per language at most
``SAMPLE_DOCS`` labelled documents and ``SAMPLE_WORDS`` of their distinct words, chosen by hash.  Only these words and the
weights pass the driver.  A document trains only if crc32 of its id modulo 4 is not 2.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every text if nothing is labelled;
a null lang never trains; equal probabilities go to the first language in order; repeated rows are labelled alike; other
columns pass through (one named like a result is replaced), and none but the text takes part in a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried

HIDDEN = 16
LONGEST = 24
SAMPLE_DOCS, SAMPLE_WORDS = 300, 12_000
EPOCHS, BATCH, RATE = 6, 256, 0.01
REMEMBERED = 600_000
UNKNOWN = "und"


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One gated recurrent layer; the input weights are a table with one row per byte."""

    def __init__(self, rng, hidden: int):
        self.w = {
            "x": rng.normal(0, 0.2, (257, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
        }

    def forward(self, codes: np.ndarray, mask: np.ndarray, order, keep: bool):
        """States after every position of (rows, steps) byte codes; padding keeps the state."""
        size = self.w["u"].shape[0]
        x = self.w["x"] + self.w["b"]
        h = np.zeros((len(codes), size), x.dtype)
        out = np.empty((*codes.shape, size), x.dtype)
        memory = []
        for t in order:
            a, g = x[codes[:, t]], h @ self.w["u"]
            gates = _sigmoid(a[:, : 2 * size] + g[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = np.tanh(a[:, 2 * size :] + r * g[:, 2 * size :])
            m = mask[:, t, None]
            after = h + m * (1 - z) * (n - h)
            if keep:
                memory.append((t, h, z, r, n, g[:, 2 * size :], m))
            h = after
            out[:, t] = h
        return out, memory

    def backward(self, codes, memory, d_out):
        size = self.w["u"].shape[0]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        d_h = np.zeros((len(codes), size), d_out.dtype)
        for t, h, z, r, n, g, m in reversed(memory):
            d_h = d_h + d_out[:, t]
            d_n = d_h * m * (1 - z) * (1 - n * n)
            d_z = d_h * m * (h - n) * z * (1 - z)
            d_r = d_n * g * r * (1 - r)
            d_a = np.concatenate((d_z, d_r, d_n), axis=1)
            d_g = np.concatenate((d_z, d_r, d_n * r), axis=1)
            np.add.at(grads["x"], codes[:, t], d_a)
            grads["b"] += d_a.sum(axis=0)
            grads["u"] += h.T @ d_g
            d_h = d_h * (1 - m * (1 - z)) + d_g @ self.w["u"].T
        return grads


class Network:
    """Two directions and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.top = {"o": rng.normal(0, 0.1, (2 * hidden, classes)).astype(np.float32), "c": np.zeros(classes, np.float32)}

    def probabilities(self, codes, mask, keep: bool = False):
        steps = codes.shape[1]
        one, memory_one = self.ahead.forward(codes, mask, range(steps), keep)
        two, memory_two = self.back.forward(codes, mask, range(steps - 1, -1, -1), keep)
        both = np.concatenate((one, two), axis=2)
        logits = both @ self.top["o"] + self.top["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, (both, memory_one, memory_two)

    def gradients(self, codes, mask, labels, weights):
        """(loss, gradients) of the mean cross-entropy over positions; one label per row."""
        p, (both, memory_one, memory_two) = self.probabilities(codes, mask, keep=True)
        share = (mask * weights[:, None]) / max((mask * weights[:, None]).sum(), 1e-9)
        rows = np.arange(len(codes))
        loss = -(share * np.log(np.maximum(p[rows, :, labels], 1e-9))).sum()
        d = p.copy()
        d[rows, :, labels] -= 1
        d *= share[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        top = {"o": both.reshape(-1, both.shape[2]).T @ flat, "c": flat.sum(axis=0)}
        d_both = d @ self.top["o"].T
        size = both.shape[2] // 2
        return loss, [self.ahead.backward(codes, memory_one, d_both[:, :, :size]), self.back.backward(codes, memory_two, d_both[:, :, size:]), top]

    @property
    def parts(self):
        return [self.ahead.w, self.back.w, self.top]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, mask) of byte strings of at most LONGEST bytes; 256 pads."""
    steps = max(map(len, words), default=1)
    codes = np.full((len(words), steps), 256, np.int32)
    mask = np.zeros((len(words), steps), np.float32)
    lengths = np.array([len(w) for w in words])
    inside = np.arange(steps) < lengths[:, None]
    codes[inside] = np.frombuffer(b"".join(words), np.uint8)
    mask[inside] = 1
    return codes, mask


def train(words: list[bytes], labels: np.ndarray, weights: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over batches of words of like length."""
    net = Network(classes, seed=seed)
    rng = np.random.default_rng(seed)
    first = [{k: np.zeros_like(v) for k, v in part.items()} for part in net.parts]
    second = [{k: np.zeros_like(v) for k, v in part.items()} for part in net.parts]
    lengths = np.array([len(w) for w in words])
    step = 0
    for epoch in range(epochs):
        order = np.lexsort((rng.random(len(words)), lengths))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            rows = batches[k]
            codes, mask = padded([words[i] for i in rows])
            _, grads = net.gradients(codes, mask, labels[rows], weights[rows])
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for part, grad, one, two in zip(net.parts, grads, first, second):
                for name, g in grad.items():
                    one[name] += 0.1 * (g - one[name])
                    two[name] += 0.001 * (g * g - two[name])
                    part[name] -= (rate * one[name] / (np.sqrt(two[name]) + 1e-8)).astype(np.float32)
    return net


@dataclass
class Model:
    languages: list[str]
    network: Network | None


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _pieces(texts):
    """Words with a letter or a byte above ASCII, cut to LONGEST bytes: (raw, starts, ends, first)."""
    raw, offsets = W.utf8_of(texts)
    raw = W.lower_latin(raw)
    starts, ends, first = W.trimmed(raw, *W.word_bounds(raw, offsets))
    letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    keep = letters[ends] > letters[starts]
    starts, ends, first = starts[keep], ends[keep], np.concatenate(([0], np.cumsum(keep)))[first]
    cuts = -(-(ends - starts) // LONGEST)
    if len(cuts) and cuts.max() > 1:
        at = np.concatenate(([0], np.cumsum(cuts)))
        nth = np.arange(at[-1]) - np.repeat(at[:-1], cuts)
        starts = np.repeat(starts, cuts) + nth * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, cuts))
        first = at[first]
    return raw, starts, ends, first


class Labeller:
    """Pooled probabilities of texts; remembers the position sums of words."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[int, int] = {}
        self.sums = np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for i in range(0, len(order), 2048):
            rows = order[i : i + 2048]
            codes, mask = padded([words[k] for k in rows])
            p, _ = self.model.network.probabilities(codes, mask)
            out[rows] = (p * mask[:, :, None]).sum(axis=1)
        return out

    def pooled(self, texts) -> np.ndarray:
        """(rows, languages) mean probabilities; a row of zeros where there is nothing to label."""
        raw, starts, ends, first = _pieces(texts)
        n = len(first) - 1
        out = np.zeros((n, len(self.model.languages)))
        if not len(starts):
            return out
        distinct, example, inverse = np.unique(W.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        fresh = [k for k, key in enumerate(keys) if key not in self.place]
        if len(self.place) + len(fresh) > REMEMBERED:
            self.place, self.sums = {}, self.sums[:0]
            fresh = list(range(len(keys)))
        if fresh:
            data = raw.tobytes()
            words = [data[starts[e] : ends[e]] for e in example[fresh]]
            self.place.update(zip([keys[k] for k in fresh], range(len(self.sums), len(self.sums) + len(fresh))))
            self.sums = np.concatenate((self.sums, self._learn(words)))
        sums = self.sums[[self.place[key] for key in keys]][inverse]
        some = np.flatnonzero(np.diff(first))
        totals = np.add.reduceat(sums.astype(np.float64), first[some], axis=0)
        positions = np.add.reduceat(ends - starts, first[some])
        out[some] = totals / positions[:, None]
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, seed: int = 7) -> Model:
    """A model of the labelled documents that aren't held out (doc_id, text, lang)."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample_docs).select("doc_id").distinct()
    texts = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")  # sample_docs ids a language

    def split(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                raw, starts, ends, first = _pieces(part.column("text"))
                data = raw.tobytes()
                langs = part.column("lang").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first))))
                yield pa.RecordBatch.from_arrays([langs, pa.array([data[s:e] for s, e in zip(starts, ends)], pa.binary())], ["lang", "word"])

    counted = texts.mapInArrow(split, "lang string, word binary").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("times"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word")
    rows = counted.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample_words).select("lang", "word", "times").toPandas()
    if rows.empty:
        return Model([], None)
    rows = rows.sort_values(["lang", "word"])
    languages = sorted(rows["lang"].unique())
    labels = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    weights = np.sqrt(rows["times"].to_numpy(np.float64)).astype(np.float32)
    for k in range(len(languages)):  # every language weighs the same
        weights[labels == k] /= weights[labels == k].mean()
    return Model(languages, train([bytes(w) for w in rows["word"]], labels, weights, len(languages), seed=seed))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text and with lang_pred and score."""
    kept = Carried(docs, text, "body", ["lang_pred", "score"])
    names = kept.names
    plain = kept.plain.withColumn("letters", F.coalesce(F.col("body").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        labeller = Labeller(model) if model.network else None
        spelled = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in W.slices(batch, "body", 3 << 20):
                n = part.num_rows
                best, score = np.full(n, len(model.languages)), np.zeros(n)
                if labeller:
                    pooled = labeller.pooled(part.column("body"))
                    some = part.column("letters").to_numpy(zero_copy_only=False) & (pooled.sum(axis=1) > 0)
                    best[some], score[some] = pooled[some].argmax(axis=1), np.minimum(pooled[some].max(axis=1), 1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(spelled[best], pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return kept.back(plain.mapInArrow(run, kept.schema("lang_pred string, score double")), "lang_pred", "score")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
