"""A filter of fixed size over the numbers of a column: no false negative; false positives are left to a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipgrove.llm.words import mix

SIZE = 1 << 24


def bit_filter(df: DataFrame, column: str, size: int = SIZE, hashed: bool = True) -> bytes:
    """Two bits per value of a long column of well mixed hashes, or with ``hashed`` false of any numbers, which are mixed first; the tasks make and merge parts of it. ``size``
    bits, a power of two, bound what the driver and the tasks hold, whatever the number of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = x if hashed else mix(x)
            for i in (x & np.uint64(size - 1), (x >> np.uint64(32)) & np.uint64(size - 1)):
                np.bitwise_or.at(out, (i >> np.uint64(3)).astype(np.int64), np.uint8(1) << (i & np.uint64(7)).astype(np.uint8))
        words = out.view(np.int64)
        at = np.flatnonzero(words)
        if len(at):
            yield pa.record_batch([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    whole = np.zeros(size // 64, np.int64)
    merged = df.select(column).dropna().mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in merged.toLocalIterator():  # at most size / 64 rows
        whole[r["at"]] = r["bits"]
    return whole.tobytes()


def passes(x: np.ndarray, bits: bytes) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    size = np.uint64(len(table) * 8 - 1)

    def one(i):
        return (table[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    return one(x & size) & one((x >> np.uint64(32)) & size)
