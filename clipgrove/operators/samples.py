"""PCM samples as rows (stream_id, source, frame, sample [, ch]): peaks, resampling, mixing, and
the placement of packets on the common frame line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clipgrove.functions import samples as A
from clipgrove.functions.timebase import idiv
from clipgrove.operators.scan import rows_chunk

# Fixed values.
BUCKETS = 1600
PROBES = 96
BLOCK = 480
SLACK = 48
RESYNC = 4800
SOURCE = ["stream_id", "source"]


def _lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("frame") + 1).alias("_frames"))


def _all_buckets(peaks: DataFrame, lengths: DataFrame, keys: list[str], n: Column) -> DataFrame:
    grid = lengths.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("bucket"))
    return grid.join(peaks, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def _peak() -> Column:
    return (F.max(F.abs(F.col("sample").cast("int"))) / A.FULL_SCALE).alias("peak")


def peaks_fixed(df: DataFrame, keys: list[str] = SOURCE, buckets: int = BUCKETS, probes: int = PROBES) -> DataFrame:
    """Peak per bucket of equal size, probed in strides inside long buckets; frames behind the
    last bucket are left out, empty buckets are 0."""
    lengths = _lengths(df, keys)
    size = F.greatest(idiv(F.col("_frames"), buckets), F.lit(1))
    b = df.join(lengths, keys).withColumn("_size", size).withColumn("bucket", idiv(F.col("frame"), F.col("_size"))).where(F.col("bucket") < buckets)
    start = F.col("bucket") * F.col("_size")
    span = F.least(F.col("_size"), F.col("_frames") - start)
    stride = F.when(span > probes, idiv(span, probes)).otherwise(1)
    peaks = b.where((F.col("frame") - start) % stride == 0).groupBy(*keys, "bucket").agg(_peak())
    return _all_buckets(peaks, lengths, keys, F.lit(buckets))


def peaks_proportional(df: DataFrame, buckets: int, keys: list[str] = SOURCE) -> DataFrame:
    """min(buckets, frames) buckets of proportional bounds; the bucket of a frame in one step."""
    lengths = _lengths(df, keys).withColumn("_n", F.greatest(F.least(F.col("_frames"), F.lit(buckets)), F.lit(1)))
    b = df.join(lengths, keys).withColumn("bucket", idiv((F.col("frame") + 1) * F.col("_n") - 1, F.col("_frames")))
    return _all_buckets(b.groupBy(*keys, "bucket").agg(_peak()), lengths, keys, F.col("_n"))


def audible(peaks: DataFrame, keys: list[str] = SOURCE) -> DataFrame:
    """Tracks with a peak above silence; the microphone always stays."""
    top = peaks.groupBy(*keys).agg(F.max("peak").alias("_top"))
    return top.where((F.col("_top") >= A.SILENCE_PEAK) | (F.col("source") == "mic")).select(*keys)


def resample(df: DataFrame, src_rate: int, out_rate: int, keys: list[str] = SOURCE) -> DataFrame:
    """Linear interpolation. Every input frame makes the output frames between itself and the
    next one, so long tracks spread over all tasks; (keys, frame, value)."""
    if src_rate == out_rate:
        return df.select(*keys, "frame", A.f32(F.col("sample")).alias("value"))
    nxt = df.select(*keys, (F.col("frame") - 1).alias("frame"), F.col("sample").alias("_next"))
    rows = df.select(*keys, "frame", "sample").join(nxt, [*keys, "frame"], "left").join(_lengths(df, keys), keys)
    i = F.col("frame")

    def up(x: Column) -> Column:
        return idiv(x * out_rate + (src_rate - 1), src_rate)

    total = idiv(F.col("_frames") * out_rate, src_rate)
    last = F.least(F.when(F.col("_next").isNull(), total - 1).otherwise(up(i + 1) - 1), total - 1)
    out = rows.withColumn("_a", up(i)).withColumn("_b", last).where("_b >= _a").withColumn("_k", F.explode(F.sequence("_a", "_b")))
    pos = F.col("_k") * F.lit(float(src_rate)) / F.lit(float(out_rate))
    s0, s1 = A.f32(F.col("sample")), A.f32(F.coalesce("_next", "sample"))
    return out.select(*keys, F.col("_k").alias("frame"), (s0 + (s1 - s0) * A.f32(pos - F.floor(pos))).alias("value"))


def mix(df: DataFrame, upto: DataFrame, channels: int = 2, block: int = BLOCK) -> DataFrame:
    """df(stream_id, source, frame, ch, sample), upto(stream_id, upto): the sum of all sources at a
    frame, clamped, silence where none; whole blocks before ``upto``."""
    sums = df.groupBy("stream_id", "frame", "ch").agg(F.sum(F.col("sample").cast("bigint")).alias("_sum"))
    blocks = idiv(F.col("upto"), block)
    grid = (
        upto.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("frame", F.explode(F.sequence(F.col("block") * block, F.col("block") * block + block - 1)))
        .withColumn("ch", F.explode(F.array(*[F.lit(c) for c in range(channels)])))
    )
    out = grid.join(sums, ["stream_id", "frame", "ch"], "left")
    value = F.least(F.greatest(F.coalesce("_sum", F.lit(0)), F.lit(-32768)), F.lit(32767)).cast("int")
    return out.select("stream_id", "block", "frame", "ch", value.alias("sample"))


def remix(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Tracks with a gain above 0, weighted, summed and soft-clipped: (stream_id, frame, ch, sample)."""
    g = gains.where("gain > 0").select(*SOURCE, "gain")
    out = df.join(g, SOURCE).groupBy("stream_id", "frame", "ch").agg(F.sum(F.col("sample") * F.col("gain")).alias("_x"))
    return out.select("stream_id", "frame", "ch", A.soft_clip(F.col("_x")).alias("sample"))


def remix_rate(tracks: DataFrame) -> DataFrame:
    """tracks(stream_id, ordinal, rate): the first rate the encoder takes, else the higher one."""
    good = F.col("rate").isin(*A.MIX_RATES)
    return tracks.groupBy("stream_id").agg(F.coalesce(F.min_by("rate", F.when(good, F.col("ordinal"))), F.lit(A.MIX_RATES[1])).alias("rate"))


# --- placement on the clock ------------------------------------------------------------

def _step(p, stamp: int, frames: int, slack: int, resync: int):
    """Expected next frame after one packet, for an array of expectations."""
    d = stamp - p
    near = np.abs(d) <= resync
    moved = p + frames + np.where(d > slack, 1, 0) - np.where(d < -slack, 1, 0)
    return np.where(near, moved, stamp + frames)


def _summarise(stamp: np.ndarray, frames: np.ndarray, slack: int, resync: int) -> list[tuple]:
    """(lo, hi, out) for expectations near the first stamp and (None, None, out) for all others."""
    first = int(stamp[0])
    lo = np.arange(first - resync, first + resync + 1)
    state, back = np.unique(np.r_[_step(lo, first, int(frames[0]), slack, resync), first + int(frames[0])], return_inverse=True)
    for s, f in zip(stamp[1:].tolist(), frames[1:].tolist()):
        if len(state) == 1:
            state = _step(state, s, f, slack, resync)
            continue
        state, again = np.unique(_step(state, s, f, slack, resync), return_inverse=True)
        back = again[back]
    out = state[back]
    ends = out[:-1]
    cut = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
    last = np.r_[cut[1:], len(ends)] - 1
    rows = [(int(lo[a]), int(lo[b]), int(ends[a])) for a, b in zip(cut, last)]
    return [*rows, (None, None, int(out[-1]))]


def place(df: DataFrame, keys: list[str] = SOURCE, order: str = "seq", slack: int = SLACK, resync: int = RESYNC, chunk_rows: int = 1 << 17) -> DataFrame:
    """df(<keys>, seq, stamp, frames): packets of a source near the expected frame follow on; a
    drift beyond ``slack`` repeats (+1) or drops (-1) one frame; beyond ``resync`` the packet goes to
    its stamp. Adds ``at`` and ``adjust``. Chunks of a source are summed up as functions of the
    expected frame, chained, and replayed; see ``stateful``."""
    base = df.where("frames > 0").withColumn("_chunk", rows_chunk(order, chunk_rows))
    last = base.groupBy(*keys).agg(F.max("_chunk").alias("_final"))
    slim = base.join(last, keys).select(*keys, "_chunk", F.col(order).alias("_order"), "stamp", "frames", (F.col("_chunk") == F.col("_final")).alias("_final"))
    fields = [df.schema[k] for k in keys] + [T.StructField("_chunk", T.LongType())]
    names = [*keys, "_chunk"]
    longs = ["_lo", "_hi", "_out"]
    step = T.StructType(fields + [T.StructField(n, T.LongType()) for n in longs])
    start = T.StructType(fields + [T.StructField("_next", T.LongType())])

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if bool(pdf["_final"].iloc[0]):  # nothing follows, so its outcome is not needed
            rows = [(None, None, None)]
        else:
            pdf = pdf.sort_values("_order")
            rows = _summarise(pdf["stamp"].to_numpy(), pdf["frames"].to_numpy(), slack, resync)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*names, *longs]).astype({n: "Int64" for n in longs})

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        expected, rows = None, []
        for number, part in pdf.groupby("_chunk", sort=True):
            rows.append((*key, number, expected))
            near = part[(part["_lo"] <= expected) & (part["_hi"] >= expected)] if expected is not None else part[:0]
            rest = part[part["_lo"].isna()]
            hit = near if len(near) else rest
            value = hit["_out"].iloc[0]
            expected = None if pd.isna(value) else int(value)
        return pd.DataFrame(rows, columns=[*names, "_next"]).astype({"_next": "Int64"})

    starts = slim.groupBy(*names).applyInPandas(summarise, step).groupBy(*keys).applyInPandas(chain, start)
    result = T.StructType(list(df.schema.fields) + [T.StructField("at", T.LongType()), T.StructField("adjust", T.IntegerType())])
    columns = df.columns

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        value = pdf["_next"].iloc[0]
        expected = None if pd.isna(value) else int(value)
        at, adjust = [], []
        for stamp, frames in zip(pdf["stamp"].tolist(), pdf["frames"].tolist()):
            if expected is None or abs(stamp - expected) > resync:
                where, change = stamp, 0
            else:
                d = stamp - expected
                where, change = expected, (1 if d > slack else -1 if d < -slack else 0)
            at.append(where)
            adjust.append(change)
            expected = where + frames + change
        return pdf[columns].assign(at=at, adjust=np.array(adjust, dtype="int32"))

    return base.join(starts, names).groupBy(*names).applyInPandas(replay, result)


def placed_frames(placed: DataFrame) -> DataFrame:
    """placed(..., at, adjust, samples ARRAY): one row per frame on the line; a repeated frame comes
    first, a dropped one is left out."""
    arr, n = F.col("samples"), F.size("samples")
    pcm = (
        F.when(F.col("adjust") == 1, F.concat(F.slice(arr, 1, 1), arr))
        .when(F.col("adjust") == -1, F.slice(arr, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(arr)
    )
    keep = [c for c in placed.columns if c not in ("samples", "at", "adjust")]
    out = placed.select(*keep, "at", F.posexplode(pcm).alias("_i", "sample"))
    return out.select(*keep, (F.col("at") + F.col("_i")).alias("frame"), "sample")
