"""Words of Arrow string batches as flat numpy arrays: the shared first step of the word operators.

A word is a maximal run of bytes other than blank and 0x09-0x0D; those bytes never occur inside a
longer UTF-8 sequence, so the split over bytes equals the split over characters.  Nulls count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2^64
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
LANES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than there are rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters (U+00C0 to U+00DE but U+00D7, bytes C3 80 to C3 9E)."""
    raw = lower_ascii(raw)
    upper = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    upper = upper[(raw[upper] >= 0x80) & (raw[upper] <= 0x9E) & (raw[upper] != 0x97)]
    raw[upper] += np.uint8(32)
    return raw


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words and, per row, the index of its first word (n + 1 entries)."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running polynomial sum."""
    n = len(raw)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    powers = np.full(n, STEP, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * powers, out=running[1:])
    inverse = np.full(n, STEP_INVERSE, np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return mix((running[ends] - running[starts]) * inverse[starts])


def ngram_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all n-grams of ``size`` words; a row of fewer words, but at least one, gives its whole sequence."""
    counts = np.diff(first)
    grams = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate(([0], np.cumsum(grams)))
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    rows = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(total) - out_first[rows] + first[rows]
    left = first[rows + 1] - at  # words from here to the end of the row
    sums = np.zeros(total, np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for k in range(size):
        sums += np.where(left > k, padded[at + k] * LANES[k], LANES[32 + k])
    return mix(sums), out_first


def distinct_sorted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per row in ascending order, rows kept apart."""
    rows = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    counts = np.bincount(rows[keep], minlength=len(first) - 1)
    return hashes[keep], np.concatenate(([0], np.cumsum(counts)))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch with about ``limit`` bytes of text each, at least one row; bounds the memory of the numpy steps."""
    sizes = np.diff(utf8_of(batch.column(column))[1])
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def complete_runs(batches, key: str):
    """Tables of whole runs of equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], side="left"))
        if cut == 0 and held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != values[-1]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """The words without ASCII punctuation at their edges; words of nothing else go."""
    n = len(raw)
    if not len(starts):
        return starts, ends, first
    inner = ~_EDGE[raw]
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(inner, at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(inner, at, -1))
    new_starts, new_ends = after[starts], before[ends - 1] + 1
    keep = new_starts < ends
    return new_starts[keep], new_ends[keep], np.concatenate(([0], np.cumsum(keep)))[first]


def plain_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the lower-cased words without punctuation at their edges."""
    raw, offsets = utf8_of(column)
    raw = lower_latin(raw)
    starts, ends, first = trimmed(raw, *word_bounds(raw, offsets))
    return span_hashes(raw, starts, ends), first
