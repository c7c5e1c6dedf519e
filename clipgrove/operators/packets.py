"""Timestamped packet streams: rows (stream_id, segment, track, seq, time, dur, key, size).

``seq`` is the arrival order, ``time`` counts 100 ns units. All running values go through
chunked scans, so one stream may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clipgrove.functions import timebase as T
from clipgrove.operators.ranges import expand
from clipgrove.operators.scan import Run, count, neighbours, repack, rows_chunk, running, span_chunk
from clipgrove.operators.timejoin import asof, interval_join

# Fixed values.
STALL_SLOTS = 3
FILL_BLOCK = 1 << 16
FPS_PROBE = 32
MAX_U32 = 4_294_967_295
FILM_COLUMNS = 16
FILM_STEP = T.SECOND
FILLER_STEP = T.SECOND // 2
AWAY_AFTER = 60 * T.SECOND
FRAME_EPS_MS = 1e-3

STREAM = ["stream_id"]
CAPTURE = ["stream_id", "segment"]
# Width of the time chunks of as-of joins and of the buckets of interval joins.
SPAN = 3600 * T.SECOND
SPAN_MS = 3_600_000


def video(df: DataFrame) -> DataFrame:
    return df.where("track = 'v'")


def _seq() -> Column:
    return rows_chunk("seq")


# --- sample order and durations --------------------------------------------------------

def monotone(df: DataFrame, keys: list[str], start: str = "start", order: str = "seq") -> DataFrame:
    """A start that does not advance becomes the one before + 1: i + max(start_j - j)."""
    ranked = repack(df, keys, [order], rows_chunk(order), "_i")
    out = running(ranked, keys, ["_i"], {"_top": Run("max", F.col(start) - F.col("_i"))}, rows_chunk("_i"))
    return out.withColumn(start, F.col("_i") + F.col("_top")).select(*df.columns)


def durations(df: DataFrame, keys: list[str], start: str = "start", own: str = "own_dur", order: str = "seq") -> DataFrame:
    """Distance to the next start; the last row has its own duration, at least 1."""
    out = neighbours(df, keys, [order], rows_chunk(order), following={"_next": F.col(start)})
    dur = F.least(F.coalesce(F.col("_next") - F.col(start), F.greatest(F.col(own), F.lit(1))), F.lit(MAX_U32))
    return out.withColumn("dur_ticks", dur.cast("bigint")).drop("_next")


def gop_id(df: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Number of keyframes so far; 0 before the first."""
    return running(df, keys, ["seq"], {"gop": Run("sum", F.col("key").cast("bigint"))}, _seq())


def in_order(df: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    out = neighbours(df, keys, ["seq"], _seq(), prev={"_before": F.col("time")})
    return out.groupBy(*keys).agg(F.bool_and(F.col("_before").isNull() | (F.col("time") >= F.col("_before"))).alias("in_order"))


def fps_from_gaps(df: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Frames per second from the first 32 times in arrival order: upper median of the positive
    gaps. The rank filter limits rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    head = df.select(*keys, "seq", "time").withColumn("_r", rank).where(F.col("_r") <= FPS_PROBE)
    gap = F.col("time") - F.lag("time").over(W.partitionBy(*keys).orderBy("time"))
    gaps = head.withColumn("_gap", gap)
    sorted_gaps = F.array_sort(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap"))))
    out = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sorted_gaps.alias("_g"))
    median = F.try_element_at("_g", (F.floor(F.size("_g") / 2) + 1).cast("int"))
    fps = F.greatest(F.round(F.lit(float(T.SECOND)) / median).cast("bigint"), F.lit(1))
    return out.select(*keys, F.when((F.col("_n") >= 3) & (F.size("_g") > 0), fps).alias("fps"))


# --- ring and windows ------------------------------------------------------------------

def ring(df: DataFrame, window: int, keys: list[str] = CAPTURE) -> DataFrame:
    """Rows the ring holds at the end of each capture segment: from the last keyframe at or
    before (latest - window), all rows without such a keyframe."""
    latest = df.groupBy(*keys).agg(F.max("time").alias("_latest"))
    dated = df.join(latest, keys)
    anchor = dated.where(F.col("key") & (F.col("time") <= F.col("_latest") - window)).groupBy(*keys).agg(F.max("seq").alias("_anchor"))
    return df.join(anchor, keys, "left").where(F.col("_anchor").isNull() | (F.col("seq") >= F.col("_anchor"))).select(*df.columns)


def audio_retention(df: DataFrame, window: int, fps: int) -> DataFrame:
    """Audio of the video window, one GOP more and half a second."""
    keep = window + max(fps, 8) * T.SECOND // max(fps, 1) + T.SECOND // 2
    keys = ["stream_id", "segment", "track"]
    latest = df.groupBy(*keys).agg(F.max("time").alias("_latest"))
    return df.join(latest, keys).where(F.col("time") > F.col("_latest") - keep).select(*df.columns)


# --- constant rate ---------------------------------------------------------------------

def slot_select(df: DataFrame, interval: int, keys: list[str] = STREAM) -> DataFrame:
    """Adds ``slot``; keeps rows that open a slot above all before them in arrival order."""
    if interval <= 0:
        return df.withColumn("slot", F.lit(0).cast("bigint"))
    base = df.groupBy(*keys).agg(F.min_by("time", "seq").alias("_base"))
    slotted = df.join(base, keys).withColumn("slot", T.time_slot(F.col("time"), F.col("_base"), interval)).drop("_base")
    out = running(slotted, keys, ["seq"], {"_top": Run("max", F.col("slot"), False)}, _seq())
    return out.where(F.col("_top").isNull() | (F.col("slot") > F.col("_top"))).drop("_top")


def gap_fill(kept: DataFrame, fps: int, stall: int = STALL_SLOTS, keys: list[str] = STREAM) -> DataFrame:
    """One row per slot between kept rows. A short gap takes the next row; a gap of ``stall`` or
    more repeats the last row up to one slot before its end. (keys, slot, source_seq, filled, pts);
    slots differ, so their presentation times already advance. A gap of any length is written in blocks
    of FILL_BLOCK slots, which are dealt over all tasks."""
    prev = neighbours(kept.select(*keys, "seq", "slot"), keys, ["seq"], _seq(), prev={"_slot": F.col("slot"), "_from": F.col("seq")})
    start = F.coalesce(F.col("_slot") + 1, F.col("slot"))
    out = expand(prev, start, F.col("slot"), "at", FILL_BLOCK)
    repeat = (F.col("slot") - 1 - F.col("_slot") >= stall) & (F.col("at") <= F.col("slot") - 2)
    return out.select(
        *keys, F.col("at").alias("slot"), F.when(repeat, F.col("_from")).otherwise(F.col("seq")).alias("source_seq"),
        (F.col("at") != F.col("slot")).alias("filled"), T.cfr_pts(F.col("at"), fps).alias("pts"))


def inactive_fill(df: DataFrame, intervals: DataFrame, step: int = FILLER_STEP) -> DataFrame:
    """intervals(stream_id, from_time, to_time): inside them the rows give way to fillers, at once
    and then every ``step``. The first filler and the first row afterwards are keyframes."""
    covered = asof(df, intervals, STREAM, "time", "from_time", SPAN, {"_to": "to_time"})
    real = covered.where(F.col("_to").isNull() | (F.col("time") >= F.col("_to")))
    real = real.select("stream_id", "time", "seq", "key", F.lit(False).alias("filler"))
    grid = intervals.where("to_time > from_time").withColumn("time", F.explode(F.sequence("from_time", F.col("to_time") - 1, F.lit(step).cast("bigint"))))
    fill = grid.select("stream_id", "time", F.lit(-1).cast("bigint").alias("seq"), (F.col("time") == F.col("from_time")).alias("key"), F.lit(True).alias("filler"))
    both = neighbours(real.unionByName(fill), STREAM, ["time", "seq"], span_chunk("time", SPAN), prev={"_after": F.col("filler")})
    forced = ~F.col("filler") & F.coalesce("_after", F.lit(False))
    return both.withColumn("key", F.col("key") | forced).drop("_after")


# --- segments of a recording -----------------------------------------------------------

def continuity(df: DataFrame) -> DataFrame:
    """Times restart in every segment (``seg_time``). The first keyframe of a later segment goes
    right behind all that was written; rows before it drop. Adds ``out_time``, 0 at the first
    keyframe written."""
    vkey = F.col("key") & (F.col("track") == "v")
    first = df.groupBy(*CAPTURE).agg(
        F.min_by(F.struct("seq", "seg_time"), F.when(vkey, F.col("seq"))).alias("_k"),
        F.max(F.col("seg_time") + F.col("dur")).alias("_all"))
    start = df.groupBy("stream_id").agg(F.min("segment").alias("_first"))
    seg = first.join(start, STREAM).withColumn("_is_first", F.col("segment") == F.col("_first"))
    keyed = df.join(seg.select(*CAPTURE, "_k", "_is_first"), CAPTURE)
    tail = keyed.where(F.col("seq") >= F.col("_k.seq")).groupBy(*CAPTURE).agg(F.max(F.col("seg_time") + F.col("dur")).alias("_end"))
    seg = seg.join(tail, CAPTURE, "left")
    later = ~F.col("_is_first") & F.col("_k").isNotNull()
    grow = F.when(F.col("_is_first"), F.col("_all")).when(later, F.col("_end") - F.col("_k.seg_time")).otherwise(0)
    ends = running(seg, STREAM, ["segment"], {"_before": Run("sum", grow, False)}, rows_chunk("segment"))
    shift = F.when(F.col("_is_first"), 0).when(later, F.col("_before") - F.col("_k.seg_time"))
    shifts = ends.withColumn("_shift", shift)
    base = shifts.where(F.col("_k").isNotNull()).groupBy("stream_id").agg(F.min_by(F.col("_k.seg_time") + F.col("_shift"), "segment").alias("_base"))
    out = keyed.join(shifts.select(*CAPTURE, "_shift"), CAPTURE).join(base, STREAM)
    passed = F.coalesce(F.col("seq") >= F.col("_k.seq"), F.lit(False)) | (F.col("_is_first") & (F.col("track") != "v"))
    at = F.col("seg_time") + F.col("_shift") - F.col("_base")
    return out.where(passed & (at >= 0)).select(*df.columns, at.alias("out_time"))


def split_parts(df: DataFrame) -> DataFrame:
    """(stream_id, segment, part): a new part when size or audio layout changes between segments."""
    shape = df.groupBy(*CAPTURE).agg(
        F.min_by("width", "seq").alias("width"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("track") != "v", F.col("track")))), ",").alias("layout"))
    seen = neighbours(shape, STREAM, ["segment"], rows_chunk("segment"), prev={"_w": F.col("width"), "_l": F.col("layout")})
    changed = F.col("_w").isNotNull() & ((F.col("_w") != F.col("width")) | (F.col("_l") != F.col("layout")))
    out = running(seen, STREAM, ["segment"], {"part": Run("sum", changed.cast("bigint"))}, rows_chunk("segment"))
    return out.select(*CAPTURE, "width", "layout", "part")


def recording_stats(df: DataFrame, keys: list[str] = CAPTURE) -> DataFrame:
    v = F.col("track") == "v"
    first, last = F.min_by("time", F.when(v, F.col("seq"))), F.max_by(F.col("time") + F.col("dur"), F.when(v, F.col("seq")))
    return df.groupBy(*keys).agg(
        ((last - first) / float(T.SECOND)).alias("seconds"), F.count_if(v).alias("frames"), F.sum("size").alias("bytes"),
        F.count_distinct("track").alias("tracks"), F.count_if(v & F.col("key")).alias("keyframes"))


# --- requests --------------------------------------------------------------------------

def replay(requests: DataFrame, packets: DataFrame, window: int, span: int = SPAN, columns: list[str] | None = None) -> DataFrame:
    """requests(request_id, stream_id, at): packets of the capture segment on air, from the last
    keyframe at or before (latest - window), else from its first keyframe; ``out_time`` starts at 0. ``columns`` of the
    packets are kept, all if none are given."""
    v = video(packets)
    now = asof(requests, v, STREAM, "at", "time", span, {"segment": "segment", "latest": "time"}, tie=["seq"])
    now = now.where(F.col("latest").isNotNull()).withColumn("_cut", F.col("latest") - window)
    keys = v.where("key")
    anchored = asof(now, keys, CAPTURE, "_cut", "time", span, {"_anchor": "time"}, tie=["seq"])
    first = keys.groupBy(*CAPTURE).agg(F.min("time").alias("_first"))
    based = anchored.join(first, CAPTURE, "left").withColumn("base", F.coalesce("_anchor", "_first")).where(F.col("base") <= F.col("at"))
    spans = based.select("request_id", *CAPTURE, "base", "at")
    return _rebased(packets, spans, CAPTURE, F.col("at") + 1, span, columns)


def record(requests: DataFrame, packets: DataFrame, span: int = SPAN, columns: list[str] | None = None) -> DataFrame:
    """requests(request_id, stream_id, at, stop): from the last keyframe of the running segment
    until ``stop``. ``columns`` of the packets are kept, all if none are given."""
    v = video(packets)
    now = asof(requests, v, STREAM, "at", "time", span, {"segment": "segment"}, tie=["seq"]).where("segment IS NOT NULL")
    based = asof(now, v.where("key"), CAPTURE, "at", "time", span, {"base": "time"}, tie=["seq"]).where("base IS NOT NULL")
    # Recordings that overlap have each packet once: many more rows than packets.
    return _rebased(packets, based.select("request_id", "stream_id", "base", "stop"), STREAM, F.col("stop"), span, columns, spread=True)


def _rebased(
    packets: DataFrame, spans: DataFrame, keys: list[str], end: Column, span: int, columns: list[str] | None, spread: bool = False,
) -> DataFrame:
    """Packets from ``base`` to ``end`` of every span. Packets travel packed, so columns are dropped before the join."""
    kept = columns or packets.columns
    points = packets.select(*dict.fromkeys([*keys, "time", *kept]))
    hit = interval_join(points, spans, keys, "time", F.col("base"), end, span, spread=spread)
    return hit.select("request_id", *kept, (F.col("time") - F.col("base")).alias("out_time"))


# --- layout in a file ------------------------------------------------------------------

def interleave(df: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Adds ``gop``: keyframes after the first video packet open a GOP, audio goes to the GOP whose
    next keyframe it precedes. Write order is (gop, video first, track, seq)."""
    first = video(df).groupBy(*keys).agg(F.min("seq").alias("_first"))
    side = F.when(F.col("track") == "v", 0).otherwise(1)
    opens = F.coalesce((side == 0) & F.col("key") & (F.col("seq") != F.col("_first")), F.lit(False))
    marked = df.join(first, keys, "left").withColumn("_side", side)
    out = running(marked, keys, ["time", "_side", "seq"], {"gop": Run("sum", opens.cast("bigint"))}, span_chunk("time", SPAN))
    return out.select(*df.columns, "gop")


def chunk_offsets(laid: DataFrame, base: int = 0, keys: list[str] = STREAM) -> DataFrame:
    """(keys, gop, track, offset, samples, wide) of each contiguous run in write order; ``wide``
    when a track needs offsets beyond 32 bits."""
    runs = laid.groupBy(*keys, "gop", F.when(F.col("track") == "v", 0).otherwise(1).alias("_side"), "track").agg(
        F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("samples"))
    out = running(runs, keys, ["gop", "_side", "track"], {"_at": Run("sum", F.col("_bytes"), False)}, rows_chunk("gop"))
    out = out.withColumn("offset", (F.coalesce("_at", F.lit(0)) + base).cast("bigint"))
    wide = out.groupBy(*keys, "track").agg((F.max("offset") > MAX_U32).alias("wide"))
    return out.join(wide, [*keys, "track"]).select(*keys, "gop", "track", "offset", "samples", "wide")


def track_table(df: DataFrame, scale: int) -> DataFrame:
    """Starts in ticks, advancing, per stream and track; ``own_dur`` in ticks, at least 1."""
    keys = ["stream_id", "track"]
    t = df.select(*keys, "seq", T.to_ticks(F.col("time"), scale).alias("start"), F.greatest(T.to_ticks(F.col("dur"), scale), F.lit(1)).alias("own_dur"))
    return monotone(t, keys)


def track_presentation(table: DataFrame, scale: int) -> DataFrame:
    """Leading delay, media length and presented length in ms; only a delay gives an empty edit."""
    out = table.groupBy("stream_id", "track").agg(F.min("start").alias("_a"), F.max_by(F.col("start") + F.col("own_dur"), "start").alias("_e"))
    delay, media = T.to_movie(F.col("_a"), scale), T.to_movie(F.col("_e") - F.col("_a"), scale)
    return out.select("stream_id", "track", delay.alias("delay_ms"), media.alias("media_ms"), (delay + media).alias("presented_ms"), (delay > 0).alias("empty_edit"))


def movie_duration(table: DataFrame, scale: int) -> DataFrame:
    ends = table.groupBy("stream_id", "track").agg(F.max_by(F.col("start") + F.col("own_dur"), "start").alias("_e"))
    return ends.groupBy("stream_id").agg(F.max(T.to_movie(F.col("_e"), scale)).alias("duration_ms"))


def pair_fifo(inputs: DataFrame, outputs: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """The n-th output takes the time of the n-th input; its own when inputs ran out."""
    i = repack(inputs.select(*keys, "seq", F.col("time").alias("_in")), keys, ["seq"], _seq(), "_n").drop("seq")
    o = repack(outputs, keys, ["seq"], _seq(), "_n")
    return o.join(i, [*keys, "_n"], "left").withColumn("time", F.coalesce("_in", "time")).select(*outputs.columns)


def track_layout(tracks: DataFrame) -> DataFrame:
    """tracks(clip, file_no, id, name, samples) -> (clip, place, track_id, name, ordinal, mix). Empty
    tracks do not count; ordinals run against file order. With ids: all named tracks in file
    order, ``mix`` apart; without: one track is sys, of more the first two are sys and mic."""
    used = tracks.where("samples > 0")
    # Tracks of one file: a handful of rows per clip, far below any chunk.
    back = F.row_number().over(W.partitionBy("clip").orderBy(F.col("file_no").desc())) - 1
    named = used.groupBy("clip").agg(F.max(F.col("id").isNotNull()).alias("_named"), F.count(F.lit(1)).alias("_n"))
    out = used.withColumn("ordinal", back.cast("bigint")).join(named, "clip")
    legacy = F.when(F.col("_n") == 1, "sys").when(F.col("ordinal") == 1, "sys").when(F.col("ordinal") == 0, "mic")
    track_id = F.when(F.col("_named"), F.col("id")).otherwise(legacy)
    place = F.when(F.col("_named"), F.col("file_no")).otherwise(F.when(F.col("_n") == 1, 0).otherwise(1 - F.col("ordinal")))
    name = F.when(F.col("_named"), F.col("name")).otherwise(F.lit(""))
    return out.where(track_id.isNotNull()).select(
        "clip", place.cast("bigint").alias("place"), track_id.alias("track_id"), name.alias("name"), "ordinal",
        (F.col("_named") & (track_id == "mix")).alias("mix"))


# --- frames of a clip (clip, seq, t) ---------------------------------------------------

CLIP = ["clip"]


def frame_numbers(frames: DataFrame, t: str = "t") -> DataFrame:
    return repack(frames, CLIP, [t, "seq"], span_chunk(t, SPAN), "n")


def asof_frame(q: DataFrame, frames: DataFrame, eps: float = FRAME_EPS_MS, span: int = SPAN_MS) -> DataFrame:
    """q(clip, ms) and frames(clip, n, ms): the last frame at or before ms + eps, -1 if none."""
    f = frames.select("clip", "n", F.col("ms").alias("_ms"))
    out = asof(q, f, CLIP, "ms", "_ms", span, {"frame": "n"}, tie=["n"], slack=eps)
    return out.withColumn("frame", F.coalesce("frame", F.lit(-1)).cast("bigint"))


def nearest_frame(q: DataFrame, frames: DataFrame, span: int = SPAN_MS, keys: list[str] = CLIP) -> DataFrame:
    """Nearest frame in time; of equally near ones the earlier."""
    f = frames.select(*keys, "n", F.col("ms").alias("_ms"))
    both = asof(q, f, keys, "ms", "_ms", span, {"_n0": "n", "_t0": "_ms"}, {"_n1": "n", "_t1": "_ms"}, tie=["n"])
    up = F.col("_n0").isNull() | (F.col("_t1") - F.col("ms") < F.col("ms") - F.col("_t0"))
    take = F.col("_n1").isNotNull() & up
    return both.select(*q.columns, F.when(take, F.col("_n1")).otherwise(F.col("_n0")).alias("frame"),
                       F.when(take, F.col("_t1")).otherwise(F.col("_t0")).alias("frame_ms"))


def cuts_on_keyframes(segs: DataFrame, keyframes: DataFrame, fps: Column, span: int = SPAN_MS) -> DataFrame:
    """(clip, on_keyframes): every non-empty segment starts within half a frame of a keyframe;
    clips without keyframes fail. segs has the columns ``fps`` refers to."""
    starts = segs.select("clip", "idx", F.col("start_ms").alias("ms"), (F.col("end_ms") <= F.col("start_ms")).alias("_empty"),
                         (F.lit(500.0) / F.greatest(fps, F.lit(1))).alias("_tol"))
    near = nearest_frame(starts, keyframes, span)
    ok = F.col("frame_ms").isNotNull() & (F.col("_empty") | (F.abs(F.col("frame_ms") - F.col("ms")) <= F.col("_tol")))
    return near.groupBy("clip").agg(F.bool_and(ok).alias("on_keyframes"))


def cut_retime(packets: DataFrame, offsets: DataFrame, frame_dur: int, span: int = SPAN) -> DataFrame:
    """packets(clip, seq, t, key) inside [s - half a frame, e) of the non-empty ranges of
    ``segment_offsets``, with the time in the output."""
    ranges = offsets.where("e > s").select("clip", "idx", "s", "e", "shift")
    hit = interval_join(packets, ranges, CLIP, "t", F.col("s") - frame_dur // 2, F.col("e"), span)
    return hit.select(*packets.columns, "idx", (F.col("t") - F.col("shift")).alias("out_t"))


def opens_on_keyframe(cut: DataFrame) -> DataFrame:
    """(clip, ok): the first packet of every range is a keyframe; else the clip is re-encoded."""
    per = cut.groupBy("clip", "idx").agg(F.min_by("key", F.struct("t", "seq")).alias("_key"))
    return per.groupBy("clip").agg(F.bool_and("_key").alias("ok"))


def sample_keyframes(keyframes: DataFrame, lengths: DataFrame, max_tiles: int, span: int = SPAN) -> DataFrame:
    """keyframes(clip, t), lengths(clip, dur): one tile per step, taken at the keyframe at or before
    it, without repeats; grid position 16 wide. A clip has at most ``max_tiles`` + 1 targets."""
    step = F.greatest(T.idiv(F.col("dur"), max(max_tiles, 1)), F.lit(FILM_STEP))
    targets = lengths.withColumn("target", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("dur"), F.lit(1)) - 1, step))).select("clip", "target")
    hit = asof(targets, keyframes.select("clip", "t"), CLIP, "target", "t", span, {"tile": "t"}).where("tile IS NOT NULL")
    tiles = hit.select("clip", "tile").distinct()
    i = (F.row_number().over(W.partitionBy("clip").orderBy("tile")) - 1).cast("bigint")
    return tiles.withColumn("i", i).select("clip", "i", "tile", (F.col("i") % FILM_COLUMNS).alias("col"), T.idiv(F.col("i"), FILM_COLUMNS).alias("row"))


def frame_step(q: DataFrame, frames: DataFrame, direction: int, frame_ms: float, span: int = SPAN_MS) -> DataFrame:
    """q(clip, ms): target of one step: the neighbour frame and a little of its length; NULL with
    fewer than two frames."""
    table = neighbours(frames.select("clip", "n", "ms"), CLIP, ["n"], rows_chunk("n"), following={"_next": F.col("ms")})
    size = frames.groupBy("clip").agg(F.max("n").alias("_last"))
    at = asof_frame(q, frames, span=span).join(size, "clip", "left")
    k = F.greatest(F.col("frame"), F.lit(0)) + direction
    at = at.withColumn("_to", F.greatest(F.lit(0), F.least(F.col("_last"), k)))
    t = table.select("clip", F.col("n").alias("_to"), F.col("ms").alias("_t"), "_next")
    out = at.join(t, ["clip", "_to"], "left")
    length = F.coalesce(F.col("_next"), F.col("_t") + frame_ms) - F.col("_t")
    target = F.when(F.col("_last") >= 1, F.col("_t") + F.least(F.lit(1.5), length * 0.25))
    return out.select(*q.columns, target.alias("target_ms"))


# --- changes and inactivity ------------------------------------------------------------

def changes(df: DataFrame, column: str, keys: list[str] = STREAM) -> DataFrame:
    """Rows whose value differs from the row before; NULL is a value, and the one before the first."""
    out = neighbours(df, keys, ["seq"], _seq(), prev={"_before": F.col(column)})
    return out.where(~F.col(column).eqNullSafe(F.col("_before"))).drop("_before")


def away(df: DataFrame, gap: int = AWAY_AFTER, keys: list[str] = STREAM) -> DataFrame:
    """Adds ``away``: not active and ``gap`` or more since the last activity (since the first row
    without any)."""
    out = running(df, keys, ["seq"], {
        "_active": Run("last", F.when(F.col("active"), F.col("time"))), "_start": Run("min", F.col("time"))}, _seq())
    since = F.col("time") - F.coalesce("_active", "_start")
    return out.withColumn("away", ~F.col("active") & (since >= gap)).drop("_active", "_start")


def away_changes(df: DataFrame, now: DataFrame, gap: int = AWAY_AFTER) -> DataFrame:
    """df(stream_id, time, active), now(stream_id, now) -> (stream_id, at, away): away ``gap`` after an activity (or the first row) if the next
    one comes later than that, or none has come by ``now``; back at the next activity."""
    first = df.groupBy("stream_id").agg(F.min("time").alias("time"))
    marks = df.where("active").select("stream_id", "time").unionByName(first).distinct()
    seen = neighbours(marks, STREAM, ["time"], span_chunk("time", SPAN), following={"_next": F.col("time")}).join(now, STREAM, "left")
    left = seen.where((F.col("_next") > F.col("time") + gap) | (F.col("_next").isNull() & (F.col("now") >= F.col("time") + gap)))
    gone = left.select("stream_id", (F.col("time") + gap).alias("at"), F.lit(True).alias("away"))
    return gone.unionByName(left.where("_next IS NOT NULL").select("stream_id", F.col("_next").alias("at"), F.lit(False).alias("away")))


def recent(df: DataFrame) -> list[Column]:
    """Order of seen games: last seen first."""
    return [F.col("last_seen").desc(), F.col("name").asc()]
