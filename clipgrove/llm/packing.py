"""Packing token sequences into windows: full windows first, then best-fit decreasing over a segment tree.

A document longer than a window is cut into full windows; what is left of each document is placed by best fit, longest first. A segment tree
over remaining capacities counts the open windows of each, so the tightest one that still takes a piece is found in
logarithmic time. Windows that stay open with more than ``slack`` free places are then closed: the emptiest of them is cut up to fill the others.
What is left of the last one is written as sequences of a power of two, which need no padding.

Texts are encoded and packed where they are read, in groups of bounded size, so nothing is shuffled; a task holds one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from clipgrove.llm import tokenfiles
from clipgrove.llm.words import text_slices


@dataclass(frozen=True)
class Window:
    """``tokenizer``: path of a tokenizers file; ``end``: id behind each document; ``size``: ids of a window, a power of two; ``pad``: id behind the
    pieces of a window that is not full; ``slack``: free places that are padded and not filled; ``ids``, ``pieces``: what a
    group holds at most when it is packed (and the document that ends it)."""

    tokenizer: str
    end: int = 1
    size: int = 2048
    pad: int = 0
    slack: int = 4
    ids: int = 1 << 22
    pieces: int = 1 << 16

    def __post_init__(self):
        if self.size < 1 or self.size & self.size - 1:
            raise ValueError("size must be a power of two")


class Open:
    """Open windows by remaining capacity: a segment tree whose leaves count the windows of each capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.of: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        x = self.leaves + capacity
        while x:
            self.count[x] += by
            x >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.of[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with at least ``need`` places, which is no longer open."""
        count, x = self.count, self.leaves + need
        if not count[x]:
            while x & 1 or not count[x + 1]:
                x >>= 1
                if x <= 1:
                    return None
            x += 1
            while x < self.leaves:
                x *= 2
                if not count[x]:
                    x += 1
        capacity = x - self.leaves
        self._change(capacity, -1)
        return capacity, self.of[capacity].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of items: every item, from the longest to the shortest (equal ones in their order), goes to the tightest
    window that takes it, else to a new one."""
    tree, windows = Open(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(windows)
            windows.append([])
        windows[found[1]].append(i)
        if found[0] > lengths[i]:
            tree.put(found[0] - lengths[i], found[1])
    return windows


def _cut(pieces: list[tuple[int, int, int]], n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(the last ``n`` ids of the pieces, the rest); a piece is (item, from, length)."""
    tail: list[tuple[int, int, int]] = []
    while n:
        item, at, length = pieces[-1]
        got = min(n, length)
        tail.append((item, at + length - got, got))
        pieces = pieces[:-1] + ([(item, at, length - got)] if got < length else [])
        n -= got
    return tail[::-1], pieces


def pack(lengths: list[int], size: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, from, length) for items of any length of at least one."""
    out = [[(i, a, size)] for i, n in enumerate(lengths) for a in range(0, n - size + 1, size)]
    rest = [(i, n % size) for i, n in enumerate(lengths) if n % size]
    windows = [[(rest[k][0], lengths[rest[k][0]] - rest[k][1], rest[k][1]) for k in w] for w in best_fit([n for _, n in rest], size)]
    free = [size - sum(n for *_, n in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: (free[w], w))
    out += [windows[w] for w in order if free[w] <= slack]
    order = [w for w in order if free[w] > slack]
    while order:  # the emptiest gives, the fullest takes
        last = order.pop()
        give = windows[last]
        while give and order:
            held = size - free[last]
            got = min(free[order[0]], held)
            tail, give = _cut(give, got)
            windows[order[0]] += tail
            free[order[0]] -= got
            free[last] += got
            if free[order[0]] <= slack:
                out.append(windows[order.pop(0)])
        if give and size - sum(n for *_, n in give) <= slack:
            out.append(give)
        elif give:
            left = sum(n for *_, n in give)
            while left:  # the largest power of two first
                part = 1 << left.bit_length() - 1
                tail, give = _cut(give, part)
                out.append(tail)
                left -= part
    return out


FILE = "sequence_id long, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>, ids array<int>"
_PIECE = ("doc_id", "start", "length", "doc_tokens", "offset")


def _packer(w: Window):
    def sequences(docs: list, bodies: list[np.ndarray], number: int) -> pa.RecordBatch:
        lengths = [len(b) for b in bodies]
        found = pack(lengths, w.size, w.slack)
        rows: list[list] = [[] for _ in _PIECE]
        ids, at, ends = [], [0], [0]
        for pieces in found:
            offset = 0
            for item, start, n in pieces:
                for c, v in zip(rows, (docs[item], start, n, lengths[item], offset)):
                    c.append(v)
                ids.append(bodies[item][start:start + n])
                offset += n
            if offset & offset - 1:
                ids.append(np.full(w.size - offset, w.pad, np.int32))
                offset = w.size
            ends.append(len(rows[0]))
            at.append(at[-1] + offset)
        parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], names=list(_PIECE))
        return pa.record_batch([
            pa.array(range(number, number + len(found)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))], names=["sequence_id", "pieces", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenfiles.Encoder(tokenfiles.Settings(w.tokenizer, end=w.end))
        number, docs, bodies, held = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, data, offs in text_slices(batch.column("text")):
                flat, at = enc.encode(data, offs)
                for d, x, y in zip(range(a, b), at[:-1].tolist(), at[1:].tolist()):
                    docs.append(names[d])
                    bodies.append(np.append(flat[x:y], np.uint16(w.end)))
                    held += y - x + 1
                    if held >= w.ids or len(docs) >= w.pieces:
                        out = sequences(docs, bodies, number)
                        number, docs, bodies, held = number + len(out), [], [], 0
                        yield out
        if docs:
            yield sequences(docs, bodies, number)

    return run


def write_windows(documents: DataFrame, path: str, window: Window) -> None:
    """Writes ``documents`` (doc_id long, text) as sequences of at most ``size`` ids to ``path``: sequence_id, pieces (doc_id, start, length, doc_tokens,
    offset) and ids. Ids behind the last piece are padding; a sequence of a power of two has none.

    Every row is a document of its own, repeated rows and null ids too; null and empty texts have the end id only. Every id lies in exactly
    one piece. Only doc_id and text are read. An empty table writes no sequence. Groups are cut in the order of the rows of a task, so
    documents of one sequence come from one part of the input; a task that is run again writes the same."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs.mapInArrow(_packer(window), FILE).write.option("compression", "zstd").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        pieces, ids = batch.column("pieces"), batch.column("ids")
        flat = pieces.flatten()
        own = np.repeat(np.arange(len(batch)), np.diff(pieces.offsets.to_numpy()))
        first = ids.offsets.to_numpy()[own] + flat.field("offset").to_numpy()
        n, words = flat.field("length").to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(words[a:b]) for a, b in zip(first.tolist(), (first + n).tolist())]
        yield pa.record_batch([flat.field("doc_id"), flat.field("start"), flat.field("length"), pa.array(crc, pa.int64()), flat.field("doc_tokens"),
                               batch.column("sequence_id").take(pa.array(own)), flat.field("offset")],
                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def piece_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per piece in the files: doc_id, start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset."""
    return read_windows(spark, path).mapInArrow(
        _digests, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
