"""Words of whole texts as numpy arrays, for the operators that work on Arrow batches.

A word is a run of bytes that are not ASCII white space; A-Z count as a-z. Texts are taken in
slices of a few MB, so a batch of long texts needs little memory; a single longer text is one slice.
Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
WHITE = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Values of bytes and weights of places in a word; the weights grow with the longest word."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.white = np.zeros(256, dtype=bool)
        self.white[list(WHITE)] = True
        self.plain = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[self.lower]
        self.weight = np.zeros(0, np.uint64)

    def weights(self, n: int) -> np.ndarray:
        if len(self.weight) < n:
            size = max(1024, 2 * n)
            self.weight = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        return self.weight


_tables: list[_Tables] = []


def tables() -> _Tables:
    if not _tables:
        _tables.append(_Tables())
    return _tables[0]


def text_slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) over the rows of a string column."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + budget, side="right")) - 1)
        yield at, end, raw[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text and in all) of the words of the slice. ``plain``: words are
    runs of letters and digits, so marks at a word do not matter."""
    inside = tables().plain[data] if plain else ~tables().white[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    b = offs[:-1][offs[:-1] < n]
    first[b] = inside[b]
    e = offs[1:][offs[1:] > 0] - 1
    last[e] = inside[e]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words: every byte times a random weight of its place in the word, summed up and mixed.
    Weights are unrelated numbers and not powers of a base, so no pattern of letters makes all words of its kind collide."""
    if not len(start):
        return np.zeros(0, np.uint64)
    t, n = tables(), len(data)
    size = end - start
    longest = int(size.max())
    weights = t.weights(longest + 1)[:longest + 1]
    kind = np.int32 if n < 1 << 31 else np.int64
    place = np.arange(n, dtype=kind)
    place[start[0]:] -= np.repeat(start.astype(kind), np.diff(np.append(start, n)))
    np.minimum(place, longest, out=place)  # behind a word
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(t.value[data] * weights[place], out=total[1:])
    return mix((total[end] - total[start]) ^ mix(size.astype(np.uint64)))


def shingles(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``n`` words from each position, shingles before each text and in all), repeats
    included. A text of fewer words has one shingle, its whole sequence; one without words has none."""
    counts = np.diff(before)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    if not len(h):
        return np.zeros(0, np.uint64), at
    k = np.uint64(0xD6E8FEB86659FD93)
    rolled = h[:len(h) - n + 1].copy() if len(h) >= n else h[:0]
    for i in range(1, n):
        rolled = rolled * k + h[i:len(h) - n + 1 + i]
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    full = np.repeat(counts >= n, made)
    where = np.arange(int(at[-1])) - np.repeat(at[:-1], made) + np.repeat(before[:-1], made)
    out[full] = mix(rolled[where[full]])
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        x = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in h[before[d]:before[d + 1]]:
                x = x * k + w
        out[at[d]] = mix(np.array([x], np.uint64))[0]
    return out, at


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or, if ``df`` has such a column, the name with lines before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row i holds ``values[at[i]:at[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
