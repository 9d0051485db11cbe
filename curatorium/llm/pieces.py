"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's state is the longest suffix of the text that begins a piece; following its output links
gives every piece that ends here, longest first, and each relaxes the best score of this position.  The piece scores of the
vocabulary file are the log-scores of the unigram decoder.  A character that is no piece costs more than any piece and is
written as its UTF-8 bytes.  Blanks become U+2581 and one is put in front, as the file's normalizer says.

No piece has a U+2581 after another character (checked when a file is loaded), so the best segmentation of a text is that
of its runs "blanks, then other characters" one after the other; a worker remembers the ids of frequent runs, up to a bound.

Nothing is shuffled or collected.  Defined cases: a null text has null ids, an empty one an empty list; U+2581 inside a text
comes back as a blank (as in the library), every other text decodes to itself; repeated rows are encoded alike; other
columns pass through (one named like a result is replaced).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried

SPACE = "▁"
REMEMBERED = 500_000
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4


class Pieces:
    """Pieces of a vocabulary file and the automaton over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies with an identity normalizer are supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.entries = [(p.piece, p.score, p.type) for p in model.pieces]
        words = {p: (s, i) for i, (p, s, t) in enumerate(self.entries) if t in (NORMAL, USER)}
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.entries) if t == BYTE}
        self.unknown_id = next(i for i, (_, _, t) in enumerate(self.entries) if t == UNKNOWN)
        self.unknown_score = min(s for s, _ in words.values()) - 10
        self._build(words)
        alphabet = set().union(*words)
        whole = any(SPACE in p.lstrip(SPACE) for p in words)
        breaks = "".join(re.escape(c) for c in map(chr, range(32)) if c not in alphabet)
        self.runs = re.compile(r"(?s).+" if whole else f"[{breaks}]|{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+").findall
        self.surface = [self._surface(p, t) for p, _, t in self.entries]

    def _build(self, words) -> None:
        self.next, self.own = [{}], [None]
        for piece, (score, number) in words.items():
            state = 0
            for char in piece:
                if char not in self.next[state]:
                    self.next[state][char] = len(self.next)
                    self.next.append({})
                    self.own.append(None)
                state = self.next[state][char]
            self.own[state] = (len(piece), score, number)
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                for char, child in self.next[state].items():
                    back = self.fail[state]
                    while back and char not in self.next[back]:
                        back = self.fail[back]
                    back = self.next[back].get(char, 0)
                    self.fail[child] = back
                    self.link[child] = back if self.own[back] else self.link[back]
                    below.append(child)
            level = below
        self.ends = [()] * len(self.next)

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else b""

    def _step(self, state: int, char: str) -> int:
        """The state after ``char``; a transition found over failure links is kept with the state."""
        at = state
        while at and char not in self.next[at]:
            at = self.fail[at]
        to = self.next[at].get(char, 0)
        if to:
            self.next[state][char] = to
        return to

    def _ending(self, state: int) -> tuple:
        """Pieces that end in ``state``, longest first, along the output links; kept with the state."""
        found, at = [], state if self.own[state] else self.link[state]
        while at:
            found.append(self.own[at])
            at = self.link[at]
        self.ends[state] = tuple(found)
        return self.ends[state]

    def best(self, run: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores; the longer last piece wins a tie."""
        move, ends = self.next, self.ends
        n = len(run)
        score, came = [0.0], [(0, 0)]
        state = 0
        for end, char in enumerate(run, 1):
            to = move[state].get(char)
            state = self._step(state, char) if to is None else to
            top, way, length = -np.inf, (0, 0), 0
            for length, gain, number in ends[state] or self._ending(state):
                value = score[end - length] + gain
                if value > top:
                    top, way = value, (end - length, number)
            if length != 1:  # the last one is the shortest: this character is no piece
                value = score[end - 1] + self.unknown_score
                if value > top:
                    top, way = value, (end - 1, -1)
            score.append(top)
            came.append(way)
        ids, at = [], n
        while at:
            start, number = came[at]
            if number >= 0:
                ids.append(number)
            elif self.bytes_of:
                ids.extend(self.bytes_of[b] for b in reversed(run[start:at].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown_id)
            at = start
        return ids[::-1]

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoder(path: str):
    """A function from a text to its ids (int32 array) that remembers the ids of runs."""
    model = pieces(path)
    known: dict[str, bytes] = {}

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        runs = model.runs((SPACE if model.prefix else "") + text.replace(" ", SPACE))
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, runs)), np.int32)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for run in runs:
                ids = known.get(run)
                if ids is None:
                    ids = np.array(model.best(run), np.int32).tobytes()
                    if len(run) <= 64:
                        known[run] = ids
                out.append(ids)
            return np.frombuffer(b"".join(out), np.int32)

    return encode


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` without its text, with ids (array<int>) and, if ``check``, round_trip (the ids decode to the text)."""
    kept = Carried(docs, text, "body", ["ids", *["round_trip"] * check])
    names = kept.names

    def run(batches):
        to_ids, model = encoder(path), pieces(path)
        for batch in batches:
            for part in W.slices(batch, "body"):
                texts = part.column("body").to_pylist()
                ids = [to_ids(t or "") for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in texts]))
                out = [*[part.column(n) for n in names], lists]
                if check:
                    out.append(pa.array([None if t is None else model.decode(x.tolist()) == t for t, x in zip(texts, ids)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, [*names, "ids", *["round_trip"] * check])

    coded = kept.plain.mapInArrow(run, kept.schema("ids array<int>" + ", round_trip boolean" * check))
    return kept.back(coded, "ids", *["round_trip"] * check)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``coded`` without its ids, with text; null ids give a null text."""
    kept = Carried(coded, ids, "body", ["text"])
    names = kept.names

    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return kept.back(kept.plain.mapInArrow(run, kept.schema("text string")), "text")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), check=True)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids", "round_trip")
