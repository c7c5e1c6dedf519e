"""Sample tables of media tracks: runs, chunk maps, sync numbers, fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clipgrove.functions import timebase as T
from clipgrove.operators.ranges import expand
from clipgrove.operators.scan import CHUNK_ROWS, Run, neighbours, rows_chunk, running
from clipgrove.operators.timejoin import asof

CLIP = ["clip"]
SPAN = 1 << 20


def rle(df: DataFrame, keys: list[str], value: str, order: str = "seq") -> DataFrame:
    """(keys, run, first, n, value): rows of equal value next to each other."""
    chunk = rows_chunk(order)
    seen = neighbours(df.select(*keys, order, value), keys, [order], chunk, prev={"_before": F.struct(F.col(value).alias("v"))})
    change = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))
    marked = running(seen, keys, [order], {"run": Run("sum", change.cast("bigint"))}, chunk)
    out = marked.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min(value).alias(value))
    return out.withColumn("run", F.col("run") - 1)


def edit_offset(edits: DataFrame, movie_scale: int = T.MOVIE_SCALE) -> DataFrame:
    """edits(clip, i, dur, media_time) -> (clip, ok, offset): leading empty edits (-1) shift the
    track; after them one edit from 0 may follow, anything else rejects the track."""
    empty, media = F.col("media_time") == -1, F.col("media_time") == 0
    out = edits.groupBy("clip").agg(
        F.sum(F.when(empty, T.to_hns(F.col("dur"), movie_scale)).otherwise(0)).alias("offset"),
        F.count_if(~empty & ~media).alias("_other"), F.count_if(media).alias("_media"),
        F.max(F.when(empty, F.col("i"))).alias("_last_empty"), F.min(F.when(media, F.col("i"))).alias("_first_media"))
    late = F.coalesce(F.col("_last_empty") > F.col("_first_media"), F.lit(False))
    return out.select("clip", ((F.col("_other") == 0) & (F.col("_media") <= 1) & ~late).alias("ok"), "offset")


def expand_runs(runs: DataFrame, scale: int, edits: DataFrame | None = None) -> DataFrame:
    """runs(clip, i, n, delta) -> (clip, sample, t): sample times in 100 ns units."""
    n, delta = F.col("n").cast("bigint"), F.col("delta").cast("bigint")
    at = running(runs.select("clip", "i", n.alias("n"), delta.alias("delta")), CLIP, ["i"], {
        "_sample": Run("sum", F.col("n"), False), "_ticks": Run("sum", F.col("n") * F.col("delta"), False)}, rows_chunk("i"))
    shift = F.lit(0)
    if edits is not None:  # by runs, before there is a row per sample
        at = at.join(edit_offset(edits), "clip", "left").where(F.coalesce("ok", F.lit(True)))
        at, shift = at.select("clip", "n", "delta", "_sample", "_ticks", F.coalesce("offset", F.lit(0)).alias("_shift")), F.col("_shift")
    out = expand(at, F.lit(0), F.col("n") - 1, "_k")
    ticks = F.coalesce("_ticks", F.lit(0)) + F.col("_k") * F.col("delta")
    return out.select("clip", (F.coalesce("_sample", F.lit(0)) + F.col("_k")).alias("sample"), (T.to_hns(ticks, scale) + shift).alias("t"))


def samples_with_offsets(chunks: DataFrame, chunk_map: DataFrame, sizes: DataFrame, block: int = CHUNK_ROWS) -> DataFrame:
    """chunks(clip, chunk from 1, offset), chunk_map(clip, first, per_chunk), sizes(clip, sample from
    0, size) -> (clip, sample, chunk, offset, size). Tracks whose totals disagree are rejected."""
    mapped = asof(chunks, chunk_map, CLIP, "chunk", "first", SPAN, {"per_chunk": "per_chunk"}).where("per_chunk IS NOT NULL")
    at = running(mapped, CLIP, ["chunk"], {"_start": Run("sum", F.col("per_chunk").cast("bigint"), False)}, rows_chunk("chunk"))
    at = at.withColumn("_start", F.coalesce("_start", F.lit(0)))
    none = F.lit(None).cast("bigint")
    facts = [mapped.select("clip", F.col("per_chunk").cast("bigint").alias("total"), none.alias("samples"), none.alias("chunk"), none.alias("first")),
             sizes.select("clip", none, F.lit(1).cast("bigint"), none, none), chunks.select("clip", none, none, F.col("chunk").cast("bigint"), none),
             chunk_map.select("clip", none, none, none, F.col("first").cast("bigint"))]
    ok = reduce(lambda x, y: x.union(y), facts).groupBy("clip").agg(
        F.sum("total").alias("_total"), F.sum("samples").alias("_samples"), F.max("chunk").alias("_chunks"), F.min("first").alias("_low"), F.max("first").alias("_high"))
    ok = ok.where((F.col("_total") == F.col("_samples")) & (F.col("_low") >= 1) & (F.col("_high") <= F.col("_chunks") + 1)).select("clip")
    # Every sample lies in the last chunk that starts at or before it. Chunks are cut at blocks of samples, so a block needs no other; rejected
    # tracks keep no chunk.
    chunk_ends = (F.col("_start") + F.col("per_chunk")).cast("bigint")
    begun, done = T.idiv(F.col("_start"), block), T.idiv(chunk_ends - 1, block)
    held = at.where("per_chunk > 0").join(ok, "clip", "left_semi").select("clip", "chunk", "offset", "_start", chunk_ends.alias("end"), begun.alias("_first"), done.alias("_last"))
    # At most one chunk passes each border of blocks: some rows per million samples, so they go to all tasks.
    over = F.broadcast(held.where("_first < _last").select("clip", F.col("chunk").alias("_c"), F.col("_start").alias("_a"), F.col("end").alias("_e"), "_last"))
    ahead = sizes.select("clip", "sample", "size", T.idiv(F.col("sample"), block).alias("_block")).join(over, "clip").where("sample >= _a AND sample < _e AND _block < _last")
    ahead = ahead.groupBy("clip", F.col("_c").alias("chunk"), "_block").agg(F.sum("size").alias("_bytes"))
    later = held.where("_first < _last").withColumn("_block", F.explode(F.sequence(F.col("_first") + 1, F.col("_last"))))
    whole = W.partitionBy("clip", "chunk").orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)
    lead = ahead.withColumn("_lead", F.sum("_bytes").over(whole)).select("clip", "chunk", (F.col("_block") + 1).alias("_block"), "_lead")
    later = later.join(lead, ["clip", "chunk", "_block"], "left")
    opens = [held.select("clip", F.col("_start").alias("sample"), "chunk", "offset", "end"),
             later.select("clip", (F.col("_block") * block).alias("sample"), "chunk", (F.col("offset") + F.coalesce("_lead", F.lit(0))).alias("offset"), "end")]
    kind = sizes.schema["size"].dataType
    starts = opens[0].union(opens[1]).select("clip", "sample", F.lit(0).alias("_kind"), F.struct("chunk", "offset", "end").alias("_c"), F.lit(None).cast(kind).alias("size"))
    both = starts.unionByName(sizes.select("clip", "sample", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_c"].dataType).alias("_c"), "size"))
    both = both.withColumn("_block", T.idiv(F.col("sample"), block))
    row = W.partitionBy("clip", "_block").orderBy("sample", "_kind")
    rows = both.withColumn("_before", F.coalesce(F.sum("size").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    here = F.when(F.col("_kind") == 0, F.struct("_c.chunk", "_c.end", (F.col("_c.offset") - F.col("_before")).alias("base")))
    rows = rows.withColumn("_in", F.last(here, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where("_kind = 1 AND sample < _in.end").select("clip", "sample", "_in.chunk", (F.col("_in.base") + F.col("_before")).alias("offset"), "size")


def keyframes(samples: DataFrame, sync: DataFrame, tables: DataFrame) -> DataFrame:
    """samples(clip, sample, t), sync(clip, number from 1), tables(clip) with a sync table. Clips
    without one have key samples only; a number beyond the samples rejects the clip."""
    marks = sync.select("clip", (F.col("number") - 1).alias("sample"), F.lit(True).alias("_key"))
    size = samples.groupBy("clip").agg(F.count(F.lit(1)).alias("_n"))
    bad = marks.join(size, "clip").where((F.col("sample") < 0) | (F.col("sample") >= F.col("_n"))).select("clip").distinct()
    listed = tables.select("clip").distinct().withColumn("_table", F.lit(True))
    out = samples.join(marks.distinct(), ["clip", "sample"], "left").join(listed, "clip", "left").join(bad, "clip", "left_anti")
    return out.where(F.col("_table").isNull() | F.col("_key")).select("clip", "sample", "t")


def fragment_duration(frags: DataFrame, scale: Column) -> DataFrame:
    """frags(clip, fragment, base, dur or NULL, default_dur): end of the last fragment in seconds."""
    one = frags.groupBy("clip", "fragment").agg(
        (F.min("base") + F.sum(F.coalesce("dur", "default_dur"))).alias("_end"))
    return one.groupBy("clip").agg(F.max("_end").alias("end_ticks")).withColumn("seconds", F.col("end_ticks") / scale)
