"""True recurrences over ordered rows: throttles and rate limits.

A rule such as "accept when ``gap`` has passed since the last ACCEPTED row" is no window. Only rows
that raise the highest time so far can be accepted, so the others go first, in a chunked scan. The
rest is cut into spans of some gaps; a span is summed up as a step function from the last accepted
time before it to the one after it (in parallel), the steps of a key are chained (a few rows per
span), and each span is replayed from its known start (in parallel). Tasks read their spans as
sorted rows and hold the rows of one gap at most, and the result is exact."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clipgrove.operators.scan import Run, count, neighbours, rows_chunk, running, span_chunk

SPAN_GAPS = 32
NEVER = -(1 << 62)


class _Steps:
    """Step function of one span of rising times: (limit, out) = the last accepted time after it
    when the one before it is at most ``limit``; beyond the last limit nothing is accepted."""

    def __init__(self, gap: int):
        self.gap, self.entries, self.parent, self.open, self.more = gap, [], [], deque(), True

    def add(self, t: int) -> None:
        upto, here = t - self.gap, -1
        while self.open and self.open[0][0] <= upto:  # these accept this row and go on as one
            _, c = self.open.popleft()
            if here < 0:
                here = c
            else:
                self.parent[c] = here
        if self.more:  # the state before is older than the first row, which bounds the rows that can come first
            c = len(self.entries)
            self.more = not c or t - self.entries[0] < self.gap
            self.entries.append(t)
            self.parent.append(c)
            if here < 0:
                here = c
            else:
                self.parent[c] = here
        if here >= 0:
            self.open.append((t, here))

    def rows(self) -> Iterator[tuple[int, int]]:
        last = {c: t for t, c in self.open}
        before = None
        for i, t in enumerate(self.entries):
            c = i
            while self.parent[c] != c:
                self.parent[c] = c = self.parent[self.parent[c]]
            if before and before[1] != last[c]:
                yield before
            before = (t - self.gap, last[c])
        if before:
            yield before


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def _frames(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def accepted_rows(df: DataFrame, keys: list[str], time: str, order: str, gap: int, carry: list[str] = [], span_gaps: int = SPAN_GAPS) -> DataFrame:
    """(<keys>, <order>, <carry>) of the rows that come ``gap`` (above 0) or more after the last accepted row of their keys in
    ``order``; the first row always counts. ``order`` is unique within the keys; rows without a time are not accepted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = [c for c in carry if c not in (*keys, order)]
    kept = [*keys, order, *extra]
    slim = df.select(*kept, F.col(time).cast("bigint").alias("_time")).where("_time IS NOT NULL")
    rising = running(slim, keys, [order], {"_top": Run("max", F.col("_time"), False)}, rows_chunk(order))
    rising = rising.where("_top IS NULL OR _time > _top").drop("_top").withColumn("_span", span_chunk("_time", gap * span_gaps))
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("_span", T.LongType())]
    names = [*keys, "_span"]
    step = T.StructType(fields + [T.StructField("_limit", T.LongType()), T.StructField("_out", T.LongType())])
    start = T.StructType(fields + [T.StructField("_time", T.LongType())])
    result = T.StructType([T.StructField(k, df.schema[k].dataType) for k in kept])
    step_arrow, start_arrow = to_arrow_schema(step), to_arrow_schema(start)
    columns = len(kept)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, steps = None, None
            for batch in batches:
                *group, times = _columns(batch, [*names, "_time"])
                for key, t in zip(zip(*group), times):
                    if key != now:
                        if steps:
                            yield from ((*now, *r) for r in steps.rows())
                        now, steps = key, _Steps(gap)
                    steps.add(t)
            if steps:
                yield from ((*now, *r) for r in steps.rows())

        yield from _frames(rows(), step_arrow)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, span, last, before, found = None, None, NEVER, NEVER, False
            for batch in batches:
                *group, spans, limits, outs = _columns(batch, [*names, "_limit", "_out"])
                for key, number, limit, out in zip(zip(*group), spans, limits, outs):
                    if key != now:
                        now, span, last = key, None, NEVER
                    if number != span:
                        span, before, found = number, last, False
                        yield (*key, number, last)
                    if not found and before <= limit:
                        last, found = out, True

        yield from _frames(rows(), start_arrow)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, NEVER
        for batch in batches:
            *group, kinds, times = _columns(batch, [*names, "_kind", "_time"])
            hits = []
            for i, (key, kind, t) in enumerate(zip(zip(*group), kinds, times)):
                if not kind:
                    now, last = key, t
                elif t - last >= gap:
                    hits.append(i)
                    last = t
            yield pa.RecordBatch.from_arrays(batch.columns[:columns], names=kept).take(pa.array(hits, pa.int64()))

    steps = rising.select(*names, "_time").repartition(*names).sortWithinPartitions(*names, "_time").mapInArrow(summarise, step)
    starts = steps.repartition(*keys).sortWithinPartitions(*names, "_limit").mapInArrow(chain, start)
    # the start of a span is read right before its rows
    both = rising.select(*kept, "_span", F.lit(1).alias("_kind"), "_time").unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition(*names).sortWithinPartitions(*names, "_kind", "_time").mapInArrow(replay, result)


def accepted(df: DataFrame, keys: list[str], time: str, order: str, gap: int, span_gaps: int = SPAN_GAPS) -> DataFrame:
    """``df`` plus ``accepted``: the row is one of ``accepted_rows``."""
    marks = accepted_rows(df, keys, time, order, gap, span_gaps=span_gaps).withColumn("accepted", F.lit(True))
    return df.join(marks, [*keys, order], "left").select(*df.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def throttle(df: DataFrame, keys: list[str], time: str, gap: int, order: str = "seq") -> DataFrame:
    return accepted_rows(df, keys, time, order, gap, df.columns).select(*df.columns)


def rate_limit(df: DataFrame, keys: list[str], time: str, window: int, most: int, order: str = "seq") -> DataFrame:
    """A window opens at the first row more than ``window`` after the one before opened; the first
    ``most`` rows of a window pass."""
    opened = accepted(df, keys, time, order, window + 1)
    marked = running(opened, keys, [order], {"_open": Run("last", F.when(F.col("accepted"), F.col(order)))}, rows_chunk(order))
    ranked = running(marked, [*keys, "_open"], [order], {"_n": count()}, rows_chunk(order))
    return ranked.where(F.col("_n") <= most).drop("_open", "_n", "accepted")


def upsert_seen(seen: DataFrame, batch: DataFrame, gap: int = 60) -> DataFrame:
    """seen(name, appid, last_seen), batch(name, appid, at, seq): new names are added, known ones
    replaced when ``gap`` seconds passed since the kept one. Order numbers are not negative."""
    rows = seen.select("name", "appid", F.col("last_seen").alias("at"), F.lit(-1).cast("bigint").alias("seq")).unionByName(
        batch.select("name", "appid", "at", "seq"))
    kept = accepted_rows(rows, ["name"], "at", "seq", gap, ["appid", "at"])
    last = kept.groupBy("name").agg(F.max_by(F.struct("appid", F.col("at").alias("last_seen")), "seq").alias("_r"))
    return last.select("name", "_r.appid", "_r.last_seen")


# --- capture size ----------------------------------------------------------------------

# Fixed value: smaller changes of the captured size keep the pipeline.
RESIZE_TOLERANCE = 16


def _off(w: list[int], h: list[int], arrays: tuple[np.ndarray, np.ndarray], size: tuple, at: int, tolerance: int) -> int:
    """The first row from ``at`` on outside the tolerance of ``size``, or the number of rows."""
    a, b, c, d = size[0] - tolerance, size[0] + tolerance, size[1] - tolerance, size[1] + tolerance
    near = min(at + 64, len(w))
    for i in range(at, near):
        if not (a <= w[i] <= b and c <= h[i] <= d):
            return i
    at, step = near, 1024
    while at < len(w):  # a long stretch in arrays of growing size
        x, y = arrays[0][at:at + step], arrays[1][at:at + step]
        off = (x < a) | (x > b) | (y < c) | (y > d)
        i = int(np.argmax(off))
        if off[i]:
            return at + i
        at, step = at + step, 2 * step
    return len(w)


def _walk(w: np.ndarray, h: np.ndarray, size: tuple, at: int, tolerance: int) -> list[int]:
    """Rows from ``at`` on that differ from the size in use, which each of them replaces."""
    x, y, hits = w.tolist(), h.tolist(), []
    while (at := _off(x, y, (w, h), size, at, tolerance)) < len(x):
        hits.append(at)
        size = (x[at], y[at])
        at += 1
    return hits


def _last_hits(w: np.ndarray, h: np.ndarray, first: list[int], tolerance: int) -> list[int]:
    """For each row of ``first``, which sets the size: the last row of the walk from it. Walks that meet go on as one."""
    x, y, end = w.tolist(), h.tolist(), {}
    for start in reversed(first):
        path, at = [], start
        while at not in end:
            path.append(at)
            further = _off(x, y, (w, h), (x[at], y[at]), at + 1, tolerance)
            if further == len(x):
                end[at] = at
                break
            at = further
        for i in path:
            end[i] = end[at]
    return [end[i] for i in first]


def resize_rebuilds(df: DataFrame, keys: list[str], order: str = "seq", tolerance: int = RESIZE_TOLERANCE, chunk_rows: int = 1 << 17) -> DataFrame:
    """df(<keys>, seq, width, height) plus ``rebuild``: the size differs by more than ``tolerance`` in
    one direction from the one in use; the first row sets the first size.

    Only rows whose size changed can count. In a chunk of them the first row outside a tolerance
    must set a new extreme, so a chunk is summed up by its rows of extremes - at most one per pixel."""
    slim = df.select(*keys, F.col(order).alias("_order"), F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h"))
    seen = neighbours(slim, keys, ["_order"], rows_chunk("_order"), prev={"_pw": F.col("_w"), "_ph": F.col("_h")})
    changed = seen.where("_pw IS NULL OR _pw <> _w OR _ph <> _h").drop("_pw", "_ph").withColumn("_chunk", rows_chunk("_order", chunk_rows))
    fields = [df.schema[k] for k in keys] + [T.StructField("_chunk", T.LongType())]
    names, longs = [*keys, "_chunk"], ["_no", "_max_w", "_min_w", "_max_h", "_min_h", "_out_w", "_out_h"]
    step = T.StructType(fields + [T.StructField(n, T.LongType()) for n in longs])
    start = T.StructType(fields + [T.StructField("_use_w", T.LongType()), T.StructField("_use_h", T.LongType())])
    result = T.StructType(fields[:-1] + [T.StructField("_order", slim.schema["_order"].dataType)])

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        w, h = pdf["_w"].to_numpy(), pdf["_h"].to_numpy()
        tops = [np.maximum.accumulate(w), np.minimum.accumulate(w), np.maximum.accumulate(h), np.minimum.accumulate(h)]
        record = np.flatnonzero(np.any([np.r_[True, a[1:] != a[:-1]] for a in tops], axis=0))
        first = record.tolist()
        last = _last_hits(w, h, first, tolerance)
        rows = [(*key, i, *[int(a[i]) for a in tops], int(w[j]), int(h[j])) for i, j in zip(first, last)]
        return pd.DataFrame(rows, columns=[*names, *longs])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, rows = None, []
        for number, part in pdf.sort_values(["_chunk", "_no"]).groupby("_chunk", sort=True):
            rows.append((*key, number, *(size or (None, None))))
            off = part if size is None else part[
                (part["_max_w"] - size[0] > tolerance) | (size[0] - part["_min_w"] > tolerance)
                | (part["_max_h"] - size[1] > tolerance) | (size[1] - part["_min_h"] > tolerance)]
            if len(off):
                size = (int(off["_out_w"].iloc[0]), int(off["_out_h"].iloc[0]))
        return pd.DataFrame(rows, columns=[*names, "_use_w", "_use_h"]).astype({"_use_w": "Int64", "_use_h": "Int64"})

    def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        w, h, use = pdf["_w"].to_numpy(), pdf["_h"].to_numpy(), pdf["_use_w"].iloc[0]
        if pd.isna(use):
            hits = [0] + _walk(w, h, (w[0], h[0]), 1, tolerance)
        else:
            hits = _walk(w, h, (int(use), int(pdf["_use_h"].iloc[0])), 0, tolerance)
        return pdf.iloc[hits][[*keys, "_order"]]

    starts = changed.groupBy(*names).applyInPandas(summarise, step).groupBy(*keys).applyInPandas(chain, start)
    hits = changed.join(starts, names).groupBy(*names).applyInPandas(replay, result)
    marks = hits.select(*keys, F.col("_order").alias(order), F.lit(True).alias("rebuild"))
    return df.join(marks, [*keys, order], "left").select(*df.columns, F.coalesce("rebuild", F.lit(False)).alias("rebuild"))
