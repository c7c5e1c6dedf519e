"""Edit segments as interval algebra over flat rows (clip, idx, start_ms, end_ms, pos_ms,
bound_start_ms, bound_end_ms, disabled ...). Requests come as one row per clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.functions import edits as E
from clipgrove.operators.scan import Run, repack, rows_chunk, running, span_chunk
from clipgrove.operators.timejoin import asof

# Fixed values.
MIN_SEG_MS = 50.0
GAP_TOLERANCE_MS = 0.5
SPAN_MS = 3_600_000
IDX_CHUNK = 1 << 16

KEY = ["clip"]


def seg_len() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def _idx_chunk() -> Column:
    return rows_chunk("idx")


# --- edits -----------------------------------------------------------------------------

def edit_shape(segs: DataFrame) -> DataFrame:
    """One row per clip: number of segments and, for the single one, whether it is whole."""
    return segs.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(E.untrimmed(F.col("start_ms"), F.col("end_ms"), F.col("bound_start_ms"), F.col("bound_end_ms"), F.col("disabled"))).alias("whole"),
        F.min("start_ms").alias("first_start"), F.max("end_ms").alias("last_end"), F.bool_or("disabled").alias("any_disabled"),
    )


def flat_mixer(edits: DataFrame) -> Column:
    """Mixer map of edits that carry sys_vol / mic_muted columns."""
    return F.create_map(
        F.lit("sys"), F.struct(F.col("sys_vol").alias("vol"), F.lit(False).alias("muted")),
        F.lit("mic"), F.struct(F.lit(1.0).alias("vol"), F.col("mic_muted").alias("muted")),
    )


def with_noop(edits: DataFrame, segs: DataFrame) -> DataFrame:
    shaped = edits.join(edit_shape(segs), "clip", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    noop = (
        (F.col("format_kind") == "horizontal") & E.look_neutral(F.col("brightness")) & E.mixer_untouched(flat_mixer(edits))
        & ((n == 0) | ((n == 1) & F.col("whole")))
    )
    return shaped.withColumn("noop", noop)


def edited_keys(edits: DataFrame, segs: DataFrame) -> DataFrame:
    return with_noop(edits, segs).where("NOT noop").select("clip")


def fill_segments(segs: DataFrame, durations: DataFrame) -> DataFrame:
    """Old rows without position, bounds or framing. A missing position packs behind the row
    before: the last explicit position plus the lengths since then. No row = the whole clip."""
    base = segs.withColumn("_len", seg_len())
    packed = running(base, KEY, ["idx"], {"_before": Run("sum", F.col("_len"), False)}, _idx_chunk())
    packed = packed.withColumn("_before", F.coalesce("_before", F.lit(0.0)))
    packed = running(packed, KEY, ["idx"], {"_anchor": Run("last", F.col("pos_ms") - F.col("_before"))}, _idx_chunk())

    def unit(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))

    filled = packed.select(
        "clip", "idx", "start_ms", "end_ms",
        F.coalesce(F.col("pos_ms"), F.coalesce(F.col("_anchor"), F.lit(0.0)) + F.col("_before")).alias("pos_ms"),
        F.coalesce("bound_start_ms", "start_ms").alias("bound_start_ms"),
        F.coalesce("bound_end_ms", "end_ms").alias("bound_end_ms"),
        F.coalesce("disabled", F.lit(False)).alias("disabled"),
        unit(F.col("crop_x")).alias("crop_x"), unit(F.col("crop_y")).alias("crop_y"),
    )
    zero, half = F.lit(0.0), F.lit(0.5)
    empty = durations.join(segs.select("clip").distinct(), "clip", "left_anti").select(
        "clip", F.lit(0).cast("bigint").alias("idx"), zero.alias("start_ms"), F.col("duration_ms").alias("end_ms"), zero.alias("pos_ms"),
        zero.alias("bound_start_ms"), F.col("duration_ms").alias("bound_end_ms"), F.lit(False).alias("disabled"),
        half.alias("crop_x"), half.alias("crop_y"),
    )
    return sort_by_pos(filled).unionByName(empty)


def sort_by_pos(segs: DataFrame) -> DataFrame:
    old = segs.withColumnRenamed("idx", "_old")
    return repack(old, KEY, ["pos_ms", "_old"], span_chunk("pos_ms", SPAN_MS)).drop("_old")


# --- time mapping ----------------------------------------------------------------------

def _hns(ms: Column) -> Column:
    return (ms * 10000.0).cast("bigint")


def segment_offsets(segs: DataFrame) -> DataFrame:
    """Enabled segments in list order with start, end and shift in 100 ns units, and the start
    in the output in ms."""
    on = segs.where("NOT disabled").select("clip", "idx", "start_ms", "end_ms").withColumn("s", _hns(F.col("start_ms"))).withColumn("e", _hns(F.col("end_ms")))
    out = running(on, KEY, ["idx"], {
        "_kept": Run("sum", F.col("e") - F.col("s"), False), "_out": Run("sum", seg_len(), False)}, _idx_chunk())
    return out.select(
        "clip", "idx", "s", "e", (F.col("s") - F.coalesce("_kept", F.lit(0))).alias("shift"),
        F.coalesce("_out", F.lit(0.0)).alias("out_start_ms"), "start_ms", "end_ms",
    )


def kept(segs: DataFrame) -> DataFrame:
    return segs.groupBy("clip").agg(
        F.sum(F.when(F.col("disabled"), 0.0).otherwise(seg_len())).alias("kept_ms"),
        F.greatest(F.sum(_hns(F.greatest(seg_len(), F.lit(0.0)))), F.lit(1)).alias("kept_hns"),
    )


def out_to_src(q: DataFrame, segs: DataFrame) -> DataFrame:
    """q(clip, out_ms) -> segment idx and source time; beyond the end the end of the last
    enabled segment, with none enabled the start of the first."""
    ranges = segment_offsets(segs).withColumn("_end", F.col("out_start_ms") + seg_len())
    hit = asof(q, ranges, KEY, "out_ms", "_end", SPAN_MS, tie=["idx"],
               after={"_i": "idx", "_s": "start_ms", "_o": "out_start_ms", "_e": "end_ms"})
    ends = segs.groupBy("clip").agg(
        F.max_by(F.struct("idx", F.col("end_ms").alias("at")), F.when(~F.col("disabled"), F.col("idx"))).alias("_last"),
        F.min_by("start_ms", "idx").alias("_first"),
    )
    out = hit.join(ends, "clip", "left")
    inside = F.col("_s") + F.greatest(F.lit(0.0), F.least(F.col("out_ms") - F.col("_o"), F.col("_e") - F.col("_s")))
    return out.select(
        *q.columns,
        F.coalesce(F.col("_i"), F.col("_last.idx"), F.lit(0)).cast("bigint").alias("idx"),
        F.coalesce(inside, F.col("_last.at"), F.col("_first"), F.lit(0.0)).alias("src_ms"),
    )


def pos_to_out(q: DataFrame, segs: DataFrame) -> DataFrame:
    """q(clip, pos) -> output time. On an enabled block its own time, else the nearest block
    edge, the earlier one when equally near. Blocks are in order and do not overlap."""
    blocks = running(segs.where("NOT disabled").withColumn("_len", seg_len()), KEY, ["idx"],
                     {"_cum": Run("sum", F.col("_len"), False)}, _idx_chunk()).withColumn("_cum", F.coalesce("_cum", F.lit(0.0)))
    both = asof(q, blocks, KEY, "pos", "pos_ms", SPAN_MS, tie=["idx"],
                before={"_p": "pos_ms", "_l": "_len", "_c": "_cum"}, after={"_np": "pos_ms", "_nc": "_cum"})
    end = F.col("_p") + F.col("_l")
    before, after = F.col("pos") - end, F.col("_np") - F.col("pos")
    value = (
        F.when(F.col("_p").isNotNull() & (F.col("pos") <= end), F.col("_c") + (F.col("pos") - F.col("_p")))
        .when(F.col("_p").isNotNull() & (F.col("_np").isNull() | (before <= after)), F.col("_c") + F.col("_l"))
        .otherwise(F.coalesce(F.col("_nc"), F.lit(0.0)))
    )
    return both.select(*q.columns, value.alias("out_ms"))


# --- gaps and snapping -----------------------------------------------------------------

def free_gaps(segs: DataFrame, extents: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """(clip, gap_from, gap_to): free intervals between blocks by position and the tail up to
    the extent of the clip (possibly empty)."""
    blocks = segs.select("clip", "idx", "pos_ms", (F.col("pos_ms") + seg_len()).alias("_end"))
    run = running(blocks, KEY, ["pos_ms", "idx"], {"_cursor": Run("max", F.col("_end"), False)}, span_chunk("pos_ms", span_ms))
    cursor = F.greatest(F.coalesce("_cursor", F.lit(0.0)), F.lit(0.0))
    between = run.where(F.col("pos_ms") - cursor > GAP_TOLERANCE_MS).select("clip", cursor.alias("gap_from"), F.col("pos_ms").alias("gap_to"))
    ends = blocks.groupBy("clip").agg(F.max("_end").alias("_end"))
    at = F.greatest(F.coalesce("_end", F.lit(0.0)), F.lit(0.0))
    tail = extents.join(ends, "clip", "left").select("clip", at.alias("gap_from"), F.greatest(at, F.col("extent_ms")).alias("gap_to"))
    return between.unionByName(tail)


def snap_targets(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs(clip, index, playhead): 0, the playhead and the edges of the other blocks, with
    the order number that decides ties."""
    fixed = reqs.select("clip", F.explode(F.array(
        F.struct(F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("no")),
        F.struct(F.col("playhead").alias("target"), F.lit(1).cast("bigint").alias("no")))).alias("t")).select("clip", "t.*")
    others = segs.join(reqs.select("clip", "index"), "clip").where("idx <> index")
    edges = others.select("clip", F.explode(F.array(
        F.struct(F.col("pos_ms").alias("target"), (F.col("idx") * 2 + 2).alias("no")),
        F.struct((F.col("pos_ms") + seg_len()).alias("target"), (F.col("idx") * 2 + 3).alias("no")))).alias("t")).select("clip", "t.*")
    return fixed.unionByName(edges)


def snap(values: DataFrame, targets: DataFrame, radius_ms: float, keys: list[str] = KEY) -> DataFrame:
    """values(clip, value) -> snapped value and the target (NULL if none is near enough). Of
    equally near targets the later one in the list wins."""
    t = targets.withColumn("_rno", -F.col("no"))
    both = asof(values, t, keys, "value", "target", SPAN_MS, tie=["no"], tie_after=["_rno"],
                before={"_lo": "target", "_ln": "no"}, after={"_hi": "target", "_hn": "no"})
    dl, dh = F.col("value") - F.col("_lo"), F.col("_hi") - F.col("value")
    near = F.when(F.col("_hi").isNull() | (dl < dh) | ((dl == dh) & (F.col("_ln") > F.col("_hn"))), F.col("_lo")).otherwise(F.col("_hi"))
    near = F.coalesce(near, F.col("_hi"), F.col("_lo"))
    at = F.when((F.abs(near - F.col("value")) <= radius_ms) & F.lit(radius_ms > 0), near)
    return both.withColumn("at", at).select(*values.columns, F.coalesce("at", "value").alias("snapped"), "at")


# --- changes ---------------------------------------------------------------------------

def _set(**new: Column) -> list[Column]:
    return [c.alias(n) for n, c in new.items()]


def split_at(segs: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts(clip, index, src_ms): two contiguous blocks, each bounded by its own range; refused
    when a side would be shorter than the minimum."""
    target = segs.select("clip", F.col("idx").alias("index"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    ok = cuts.join(target, ["clip", "index"]).where(
        (F.col("src_ms") - F.col("_s") >= MIN_SEG_MS) & (F.col("_e") - F.col("src_ms") >= MIN_SEG_MS)
    ).select("clip", "index", "src_ms")
    rest = [c for c in segs.columns if c not in ("clip", "idx", "start_ms", "end_ms", "pos_ms", "bound_start_ms", "bound_end_ms")]
    at, idx = F.col("src_ms"), F.col("idx")

    def piece(i, s, e, pos, bs, be):
        return F.struct(*_set(idx=i, start_ms=s, end_ms=e, pos_ms=pos, bound_start_ms=bs, bound_end_ms=be))

    s, e, pos = F.col("start_ms"), F.col("end_ms"), F.col("pos_ms")
    halves = F.array(piece(idx, s, at, pos, s, at), piece(idx + 1, at, e, pos + (at - s), at, e))
    moved = idx + F.when(idx > F.col("index"), 1).otherwise(0)
    same = F.array(piece(moved, s, e, pos, F.col("bound_start_ms"), F.col("bound_end_ms")))
    out = segs.join(ok, "clip", "left").withColumn("_p", F.explode(F.when(idx == F.col("index"), halves).otherwise(same)))
    return out.select("clip", "_p.*", *rest).select(*segs.columns)


def trim(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs(clip, index, edge, src_ms). Stays inside the bounds and the minimum length; the
    start takes the position along and stops at the block before."""
    block = segs.select("clip", F.col("idx").alias("index"), "start_ms", "end_ms", "pos_ms", "bound_start_ms", "bound_end_ms")
    before = segs.select("clip", (F.col("idx") + 1).alias("index"), (F.col("pos_ms") + seg_len()).alias("_prev"))
    at = reqs.join(block, ["clip", "index"]).join(before, ["clip", "index"], "left")
    src, s, e, pos = F.col("src_ms"), F.col("start_ms"), F.col("end_ms"), F.col("pos_ms")
    floor = s + (F.coalesce("_prev", F.lit(0.0)) - pos)
    start = F.greatest(F.col("bound_start_ms"), floor, F.least(src, e - MIN_SEG_MS))
    end = F.least(F.col("bound_end_ms"), F.greatest(src, s + MIN_SEG_MS))
    is_start = F.col("edge") == "start"
    new = at.select(
        "clip", F.col("index").alias("idx"),
        F.when(is_start, start).otherwise(s).alias("_s"), F.when(is_start, e).otherwise(end).alias("_e"),
        F.when(is_start, F.greatest(F.lit(0.0), pos + (start - s))).otherwise(pos).alias("_p"),
    )
    out = segs.join(new, ["clip", "idx"], "left")
    return out.withColumns({
        "start_ms": F.coalesce("_s", "start_ms"), "end_ms": F.coalesce("_e", "end_ms"), "pos_ms": F.coalesce("_p", "pos_ms"),
    }).select(*segs.columns)


def trim_to_pos(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """``trim`` with the edge given as a timeline position (clip, index, edge, pos)."""
    block = segs.select("clip", F.col("idx").alias("index"), (F.col("start_ms") - F.col("pos_ms")).alias("_shift"))
    at = reqs.join(block, ["clip", "index"]).select("clip", "index", "edge", (F.col("_shift") + F.col("pos")).alias("src_ms"))
    return trim(segs, at)


def remove_range(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs(clip, from_pos, to_pos): takes the range out of the timeline and closes the hole.
    Short remnants go; a result without blocks or a range under 1 ms leaves the clip as it was."""
    f, t = F.col("from_pos"), F.col("to_pos")
    width = t - f
    s, e, a = F.col("start_ms"), F.col("end_ms"), F.col("pos_ms")
    b = a + (e - s)
    cut_l, cut_r = s + (f - a), s + (t - a)

    def piece(n, ss, ee, pos, bs, be):
        return F.struct(*_set(n=F.lit(n), start_ms=ss, end_ms=ee, pos_ms=pos, bound_start_ms=bs, bound_end_ms=be))

    bs, be = F.col("bound_start_ms"), F.col("bound_end_ms")
    same = F.array(piece(0, s, e, a, bs, be))
    left = F.when((a < f) & (cut_l - s >= MIN_SEG_MS), piece(0, s, cut_l, a, s, cut_l))
    right = F.when((b > t) & (e - cut_r >= MIN_SEG_MS), piece(1, cut_r, e, f, cut_r, e))
    pieces = (
        F.when(f.isNull() | (b <= f), same).when(a >= t, F.array(piece(0, s, e, a - width, bs, be)))
        .otherwise(F.filter(F.array(left, right), lambda p: p.isNotNull()))
    )
    cut = segs.join(reqs.where(width >= 1), "clip", "left").withColumn("_pieces", pieces).withColumn("_hit", f.isNotNull())
    left_over = cut.groupBy("clip").agg(F.sum(F.size("_pieces")).alias("_left"))
    out = cut.join(left_over, "clip").withColumn("_done", F.col("_hit") & (F.col("_left") > 0))
    out = out.withColumn("_p", F.explode(F.when(F.col("_done"), F.col("_pieces")).otherwise(same)))
    rest = [c for c in segs.columns if c not in ("clip", "idx", "start_ms", "end_ms", "pos_ms", "bound_start_ms", "bound_end_ms")]
    flat = out.select(
        "clip", F.col("idx").alias("_old"), F.col("_p.n").alias("_n"), F.when(F.col("_done"), F.col("_p.pos_ms")).otherwise(F.col("idx") * float(SPAN_MS) / IDX_CHUNK).alias("_by"),
        *[F.col(f"_p.{c}").alias(c) for c in ("start_ms", "end_ms", "pos_ms", "bound_start_ms", "bound_end_ms")], *rest,
    )
    return repack(flat, KEY, ["_by", "_old", "_n"], span_chunk("_by", SPAN_MS)).select(*segs.columns)


def move_to(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs(clip, index, desired, extent_ms, snap_ms, playhead): into the nearest free gap that
    fits, then either edge may stick to a target inside that gap. Without a gap nothing moves.
    The result carries ``snapped_at``."""
    block = segs.select("clip", F.col("idx").alias("index"), seg_len().alias("dur"))
    reqs = reqs.join(block, ["clip", "index"])
    others = segs.join(reqs.select("clip", "index"), "clip").where("idx <> index").select(*segs.columns)
    gaps = free_gaps(others, reqs.select("clip", "extent_ms"))
    fit = gaps.join(reqs, "clip").where(F.col("gap_to") - F.col("gap_from") >= F.col("dur") - GAP_TOLERANCE_MS)
    hi = F.col("gap_to") - F.col("dur")
    pos = F.greatest(F.col("gap_from"), F.least(F.col("desired"), hi))
    best = fit.groupBy("clip").agg(F.min_by(
        F.struct("index", "dur", "snap_ms", pos.alias("pos"), F.col("gap_from").alias("lo"), hi.alias("hi")),
        F.struct(F.abs(pos - F.col("desired")), F.col("gap_from"), F.col("gap_to"))).alias("b")).select("clip", "b.*")
    own = best.select("clip", F.explode(F.array(
        F.struct(F.col("lo").alias("at"), F.col("lo").alias("edge"), F.lit(-2).cast("bigint").alias("no")),
        F.struct(F.col("hi").alias("at"), (F.col("hi") + F.col("dur")).alias("edge"), F.lit(-1).cast("bigint").alias("no")))).alias("c")).select("clip", "c.*")
    targets = snap_targets(segs, reqs.select("clip", "index", "playhead")).join(best.select("clip", "dur"), "clip")
    other = targets.select("clip", F.explode(F.array(
        F.struct(F.col("target").alias("at"), F.col("target").alias("edge"), (F.col("no") * 2).alias("no")),
        F.struct((F.col("target") - F.col("dur")).alias("at"), F.col("target").alias("edge"), (F.col("no") * 2 + 1).alias("no")))).alias("c")).select("clip", "c.*")
    cands = own.unionByName(other).join(best.select("clip", "pos", "lo", "hi", "snap_ms"), "clip")
    dist = F.abs(F.col("at") - F.col("pos"))
    usable = F.col("at").between(F.col("lo") - GAP_TOLERANCE_MS, F.col("hi") + GAP_TOLERANCE_MS) & (dist <= F.col("snap_ms")) & (F.col("snap_ms") > 0)
    stuck = cands.where(usable).groupBy("clip").agg(F.min_by(F.struct("at", "edge"), F.struct(dist, -F.col("no"))).alias("s"))
    done = best.join(stuck, "clip", "left").select(
        "clip", F.col("index").alias("idx"), F.coalesce("s.at", "pos").alias("_pos"), F.col("s.edge").alias("snapped_at"))
    return segs.join(done, ["clip", "idx"], "left").withColumn("pos_ms", F.coalesce("_pos", "pos_ms")).select(*segs.columns, "snapped_at")


def toggle(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    hit = reqs.select("clip", F.col("index").alias("idx"), F.lit(True).alias("_hit"))
    flip = F.coalesce("_hit", F.lit(False))
    return segs.join(hit, ["clip", "idx"], "left").withColumn("disabled", F.col("disabled") != flip).select(*segs.columns)


def remove_one(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Drops block ``index``; the only block of a clip stays."""
    many = segs.groupBy("clip").agg(F.count(F.lit(1)).alias("_n"))
    ok = reqs.join(many.where("_n > 1"), "clip").join(
        segs.select("clip", F.col("idx").alias("index")), ["clip", "index"], "left_semi").select("clip", F.col("index").alias("_gone"))
    idx = F.col("idx")
    out = segs.join(ok, "clip", "left").where(F.col("_gone").isNull() | (idx != F.col("_gone")))
    return out.withColumn("idx", idx - F.when(idx > F.col("_gone"), 1).otherwise(0)).select(*segs.columns)


def set_framing(segs: DataFrame, reqs: DataFrame) -> DataFrame:
    def unit(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))

    new = reqs.select("clip", F.col("index").alias("idx"), unit("crop_x").alias("_x"), unit("crop_y").alias("_y"))
    return segs.join(new, ["clip", "idx"], "left").withColumns(
        {"crop_x": F.coalesce("_x", "crop_x"), "crop_y": F.coalesce("_y", "crop_y")}).select(*segs.columns)


def blocks_end(segs: DataFrame) -> DataFrame:
    return segs.groupBy("clip").agg(F.greatest(F.lit(0.0), F.max(F.col("pos_ms") + seg_len())).alias("end_pos"))
