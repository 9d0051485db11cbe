"""Token counts by rank-synchronous merging of byte-level BPE.

Texts are cut into pre-tokens; the distinct new ones of a slice are laid out as one ragged numpy array of symbols, and
in each round every sequence applies all occurrences of its own lowest-rank pair, leftmost first, until no pair has a
rank.  The surviving symbols are the tokens.  Counts of frequent pre-tokens are remembered per worker, up to a bound.

A word of many thousand letters has as many ranks, and rounds over its whole array would be quadratic.  Sequences longer than
``LONG`` keep the places of their pairs by rank instead: a merge makes only pairs of higher rank, so ranks are taken in
ascending order, all places of one rank in all these sequences at once, and a round touches these and their neighbours only.

Nothing is shuffled or collected; a worker holds about a megabyte of text, the merge table and the remembered counts.
Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are one token each, as the
library does by default; repeated rows are counted alike; other columns pass through (one named like a result is replaced).
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried

LIMIT = 1024
REMEMBERED = 400_000
#: Bytes of a sequence from which its pairs are kept by rank.
LONG = 512
#: Fixed: how byte-level vocabularies split a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table as sorted arrays: pair key, rank, merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = _byte_letters(), spec["model"]
        vocab = model["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, ranks = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.merged = keys, ranks.astype(np.int64), merged[ranks]
        self.none = np.int64(len(pairs))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], self.none), self.merged[at]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def count_symbols(tokens: list[bytes], table_: Merges) -> np.ndarray:
    """Symbols that survive in each sequence of bytes."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    long = lengths > LONG
    if not long.any():
        return _count_short(tokens, table_)
    counts = np.zeros(len(tokens), np.int64)
    counts[~long] = _count_short([t for t in tokens if len(t) <= LONG], table_)
    counts[long] = _count_long([t for t in tokens if len(t) > LONG], table_)
    return counts


def _count_long(tokens: list[bytes], table_: Merges) -> np.ndarray:
    lengths = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(tokens)), lengths)
    symbols = table_.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    after[ends - 1], before[ends - lengths] = -1, -1
    rank_at = np.full(n, table_.none)  # of the pair that begins at each place
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def note(at: np.ndarray) -> None:
        """Rank the pairs that begin at the places ``at``."""
        paired = after[at] >= 0
        rank_at[at[~paired]] = table_.none
        at = at[paired]
        rank = table_.look_up(symbols[at], symbols[after[at]])[0]
        rank_at[at] = rank
        ranked = rank < table_.none
        at, rank = at[ranked], rank[ranked]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else []
        for r, some in zip(rank[starts].tolist() if len(rank) else [], np.split(at, starts[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(some)

    note(np.arange(n))
    counts = lengths.copy()
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[rank_at[at] == r]  # pairs that a merge has changed since are noted elsewhere
        if not len(at):
            continue
        # of pairs that overlap ("aaa"), take every second one from the left
        run = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[place % 2 == 0]
        gone = after[at]
        symbols[at] = table_.look_up(symbols[at], symbols[gone])[1]
        rank_at[gone] = table_.none
        after[at] = after[gone]
        followed = after[at] >= 0
        before[after[at[followed]]] = at[followed]
        counts -= np.bincount(owner[at], minlength=len(counts))
        left = before[at]
        note(np.unique(np.concatenate((at, left[left >= 0]))))
    return counts


def _count_short(tokens: list[bytes], table_: Merges) -> np.ndarray:
    lengths = np.array([len(t) for t in tokens], np.int64)
    counts = lengths.copy()
    symbols = table_.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), lengths)
    while len(symbols) > 1:
        rank, merged = table_.look_up(symbols[:-1], symbols[1:])
        rank = np.where(owner[1:] == owner[:-1], rank, table_.none)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lengths = np.diff(np.append(starts, len(owner)))
        lowest = np.minimum.reduceat(np.append(rank, table_.none), starts)
        hit = (rank < table_.none) & (rank == np.repeat(lowest, lengths)[:-1])
        # of pairs that overlap ("aaa"), take every second one from the left
        at = np.flatnonzero(hit)
        if not len(at):
            break
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[place % 2 == 0]
        symbols[at] = merged[at]
        alive = np.ones(len(symbols), bool)
        alive[at + 1] = False
        counts -= np.bincount(owner[at], minlength=len(counts))
        # sequences without a ranked pair are done
        alive &= np.repeat(lowest < table_.none, lengths)
        symbols, owner = symbols[alive], owner[alive]
    return counts


def counter(path: str):
    """A function from texts to token counts that remembers the counts of pre-tokens."""
    table_ = merges(path)
    split = regex.compile(PATTERN).findall
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            if table_.special is not None and table_.special.search(text):
                pieces = table_.special.split(text)
                parts.append([t for p in pieces for t in split(p)])
                extra.append(len(pieces) - 1)
            else:
                parts.append(split(text))
                extra.append(0)
        fresh = set().union(*parts).difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = set().union(*parts)
        if fresh:
            fresh = list(fresh)
            known.update(zip(fresh, count_symbols([t.encode("utf-8", "surrogatepass") for t in fresh], table_).tolist()))
        get = known.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra)]

    return count


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit."""
    kept = Carried(docs, text, "body", ["n_bytes", "n_tokens", "over_limit"])

    names = kept.names

    def run(batches):
        count = counter(path)
        for batch in batches:
            for part in W.slices(batch, "body"):
                sizes = np.diff(W.utf8_of(part.column("body"))[1])
                tokens = count([t or "" for t in part.column("body").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(sizes), pa.array(tokens, pa.int64())], [*names, "n_bytes", "n_tokens"])

    counted = kept.plain.mapInArrow(run, kept.schema("n_bytes long, n_tokens long"))
    return kept.back(counted, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
