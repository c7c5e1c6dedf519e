"""Queries over edit segments and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import view
from clipgrove.functions import edits as E, text
from clipgrove.operators import segments as S
from clipgrove.workload import query
from clipgrove.workload.catalog import SQL_EDITED


def segs(spark, sf):
    return view(spark, sf, "fx_segments")


def orders(spark, sf, *cols):
    return view(spark, sf, "fx_edits").select(F.col("clip"), *[F.expr(c) for c in cols])


COLS = "clip, idx, start_ms, end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled"
KEEP = "cast(idx AS bigint) AS idx"


@query("w1_segment_offsets", """WITH r AS (SELECT clip, idx, cast(trunc(start_ms * 10000) AS bigint) AS s, cast(trunc(end_ms * 10000) AS bigint) AS e, end_ms - start_ms AS len
  FROM fx_segments WHERE NOT disabled)
SELECT clip, idx, s, e, s - cast(coalesce(sum(e - s) OVER w, 0) AS bigint) AS shift, coalesce(sum(len) OVER w, 0) AS out_start_ms
FROM r WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return S.segment_offsets(segs(spark, sf)).select("clip", "idx", "s", "e", "shift", "out_start_ms")


@query("a12_kept_duration", """SELECT clip, sum(CASE WHEN disabled THEN 0 ELSE end_ms - start_ms END) AS kept_ms,
  greatest(cast(sum(cast(trunc(greatest(end_ms - start_ms, 0) * 10000) AS bigint)) AS bigint), 1) AS kept_hns FROM fx_segments GROUP BY clip""")
def _(spark, sf):
    return S.kept(segs(spark, sf))


@query("w17_free_gaps", """WITH b AS (SELECT clip, idx, pos_ms, pos_ms + end_ms - start_ms AS e FROM fx_segments),
g AS (SELECT clip, pos_ms, greatest(coalesce(max(e) OVER (PARTITION BY clip ORDER BY pos_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS c FROM b),
x AS (SELECT e.clip, coalesce((SELECT max(e) FROM b WHERE b.clip = e.clip), 0) AS c, 5000.0::DOUBLE AS extent FROM fx_edits e)
SELECT clip, c AS gap_from, pos_ms AS gap_to FROM g WHERE pos_ms - c > 0.5
UNION ALL SELECT clip, c, greatest(c, extent) FROM x""")
def _(spark, sf):
    return S.free_gaps(segs(spark, sf), orders(spark, sf, "5000.0D AS extent_ms"))


@query("j17_output_to_source", """WITH r AS (SELECT clip, idx, start_ms, end_ms - start_ms AS d,
    coalesce(sum(end_ms - start_ms) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc FROM fx_segments WHERE NOT disabled),
q AS (SELECT o_orderkey AS clip, cast(o_orderkey % 40 AS double) * 70 - 20 AS out_ms FROM orders),
hit AS (SELECT q.clip, q.out_ms, r.idx, r.start_ms + greatest(0, least(q.out_ms - r.acc, r.d)) AS src
  FROM q JOIN r ON q.clip = r.clip AND q.out_ms < r.acc + r.d QUALIFY row_number() OVER (PARTITION BY q.clip, q.out_ms ORDER BY r.idx) = 1),
ends AS (SELECT clip, max(CASE WHEN NOT disabled THEN idx END) AS li, max(CASE WHEN NOT disabled THEN end_ms END) AS le, min(start_ms) AS f FROM fx_segments GROUP BY clip)
SELECT q.clip, q.out_ms, coalesce(h.idx, e.li, 0) AS idx, coalesce(h.src, e.le, e.f, 0) AS src_ms
FROM q LEFT JOIN hit h ON q.clip = h.clip AND q.out_ms = h.out_ms LEFT JOIN ends e ON q.clip = e.clip""")
def _(spark, sf):
    q = orders(spark, sf, "cast(clip % 40 AS double) * 70 - 20 AS out_ms")
    return S.out_to_src(q, segs(spark, sf))


@query("j18_position_to_output", """WITH r AS (SELECT clip, idx, pos_ms AS p, end_ms - start_ms AS d,
    coalesce(sum(end_ms - start_ms) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM fx_segments WHERE NOT disabled),
q AS (SELECT o_orderkey AS clip, cast(o_orderkey % 60 AS double) * 137 - 20 AS pos FROM orders),
c AS (SELECT q.clip, q.pos, r.idx, 0 AS rnk, 0 AS dist, 0 AS side, cum + (q.pos - p) AS v FROM q JOIN r ON q.clip = r.clip WHERE q.pos BETWEEN p AND p + d
  UNION ALL SELECT q.clip, q.pos, r.idx, 1, abs(q.pos - p), 0, cum FROM q JOIN r ON q.clip = r.clip
  UNION ALL SELECT q.clip, q.pos, r.idx, 1, abs(q.pos - p - d), 1, cum + d FROM q JOIN r ON q.clip = r.clip),
best AS (SELECT clip, v FROM c QUALIFY row_number() OVER (PARTITION BY clip ORDER BY rnk, dist, idx, side) = 1)
SELECT q.clip, q.pos, coalesce(b.v, 0) AS out_ms FROM q LEFT JOIN best b ON q.clip = b.clip""")
def _(spark, sf):
    q = orders(spark, sf, "cast(clip % 60 AS double) * 137 - 20 AS pos")
    return S.pos_to_out(q, segs(spark, sf))


SQL_REQ = """req AS (SELECT o_orderkey AS clip, o_orderkey % 4 AS index, cast(o_orderkey % 50 AS double) * 130 AS desired, cast(o_orderkey % 7 AS double) * 500 AS playhead FROM orders)"""
SQL_TARGETS = """targets AS (SELECT clip, 0.0::DOUBLE AS target, 0 AS no FROM req UNION ALL SELECT clip, playhead, 1 FROM req
  UNION ALL SELECT s.clip, pos_ms, 2 + 2 * idx FROM fx_segments s JOIN req r ON s.clip = r.clip WHERE s.idx <> r.index
  UNION ALL SELECT s.clip, pos_ms + end_ms - start_ms, 3 + 2 * idx FROM fx_segments s JOIN req r ON s.clip = r.clip WHERE s.idx <> r.index)"""


def requests(spark, sf):
    return orders(spark, sf, "clip % 4 AS index", "cast(clip % 50 AS double) * 130 AS desired", "cast(clip % 7 AS double) * 500 AS playhead")


@query("j26_snap_to_target", f"""WITH {SQL_REQ}, {SQL_TARGETS}, best AS (
  SELECT r.clip, t.target FROM req r JOIN targets t ON r.clip = t.clip WHERE abs(t.target - r.desired) <= 60
  QUALIFY row_number() OVER (PARTITION BY r.clip ORDER BY abs(t.target - r.desired), t.no DESC) = 1)
SELECT r.clip, r.desired AS value, coalesce(b.target, r.desired) AS snapped, b.target AS at FROM req r LEFT JOIN best b ON r.clip = b.clip""")
def _(spark, sf):
    req = requests(spark, sf)
    values = req.select("clip", F.col("desired").alias("value"))
    return S.snap(values, S.snap_targets(segs(spark, sf), req), 60.0)


@query("i1_split", f"""WITH c AS (SELECT o_orderkey AS clip, o_orderkey % 3 AS index, (o_orderkey % 3) * 2000.0::DOUBLE + o_orderkey % 900 AS cut FROM orders),
ok AS (SELECT c.* FROM c JOIN fx_segments s ON s.clip = c.clip AND s.idx = c.index WHERE cut - start_ms >= 50 AND end_ms - cut >= 50)
SELECT s.clip, s.idx + CASE WHEN s.idx > o.index THEN 1 ELSE 0 END AS idx, start_ms, end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled
  FROM fx_segments s LEFT JOIN ok o ON s.clip = o.clip WHERE o.clip IS NULL OR s.idx <> o.index
UNION ALL SELECT s.clip, s.idx, start_ms, cut, pos_ms, start_ms, cut, disabled FROM fx_segments s JOIN ok o ON s.clip = o.clip AND s.idx = o.index
UNION ALL SELECT s.clip, s.idx + 1, cut, end_ms, pos_ms + cut - start_ms, cut, end_ms, disabled FROM fx_segments s JOIN ok o ON s.clip = o.clip AND s.idx = o.index""")
def _(spark, sf):
    cuts = orders(spark, sf, "clip % 3 AS index", "(clip % 3) * 2000.0D + clip % 900 AS src_ms")
    return S.split_at(segs(spark, sf), cuts)


@query("i2_trim", f"""WITH r AS (SELECT o_orderkey AS clip, o_orderkey % 3 AS index, CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS edge,
  (o_orderkey % 3) * 2000.0::DOUBLE + o_orderkey % 1300 - 200 AS src FROM orders),
s AS (SELECT *, lag(pos_ms + end_ms - start_ms) OVER (PARTITION BY clip ORDER BY idx) AS prev FROM fx_segments),
j AS (SELECT s.*, r.edge, r.src, greatest(bound_start_ms, start_ms + coalesce(prev, 0) - pos_ms, least(src, end_ms - 50)) AS ns,
    least(bound_end_ms, greatest(src, start_ms + 50)) AS ne FROM s LEFT JOIN r ON s.clip = r.clip AND s.idx = r.index)
SELECT clip, idx, CASE WHEN edge = 'start' THEN ns ELSE start_ms END AS start_ms, CASE WHEN edge = 'end' THEN ne ELSE end_ms END AS end_ms,
  CASE WHEN edge = 'start' THEN greatest(0, pos_ms + ns - start_ms) ELSE pos_ms END AS pos_ms, bound_start_ms, bound_end_ms, disabled FROM j""")
def _(spark, sf):
    reqs = orders(spark, sf, "clip % 3 AS index", "CASE WHEN clip % 2 = 0 THEN 'start' ELSE 'end' END AS edge",
                  "(clip % 3) * 2000.0D + clip % 1300 - 200 AS src_ms")
    return S.trim(segs(spark, sf), reqs)


@query("i2_trim_to_pos", """WITH r AS (SELECT o_orderkey AS clip, o_orderkey % 3 AS index, cast(o_orderkey % 5000 AS double) AS pos FROM orders),
j AS (SELECT s.*, r.pos, least(bound_end_ms, greatest(start_ms + pos - pos_ms, start_ms + 50)) AS ne FROM fx_segments s LEFT JOIN r ON s.clip = r.clip AND s.idx = r.index)
SELECT clip, idx, start_ms, CASE WHEN pos IS NULL THEN end_ms ELSE ne END AS end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled FROM j""")
def _(spark, sf):
    reqs = orders(spark, sf, "clip % 3 AS index", "'end' AS edge", "cast(clip % 5000 AS double) AS pos")
    return S.trim_to_pos(segs(spark, sf), reqs)


@query("i3_ripple_delete", """WITH r AS (SELECT o_orderkey AS clip, cast(o_orderkey % 3000 AS double) AS f, cast(o_orderkey % 3000 AS double) + CASE WHEN o_orderkey % 9 = 0 THEN 0.5 ELSE o_orderkey % 2100 END AS t FROM orders),
s AS (SELECT s.*, pos_ms AS a, pos_ms + end_ms - start_ms AS b, r.f, r.t, r.t - r.f AS w FROM fx_segments s LEFT JOIN r ON s.clip = r.clip AND r.t - r.f >= 1),
p AS (
  SELECT clip, idx, 0 AS n, start_ms, end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled FROM s WHERE b <= f
  UNION ALL SELECT clip, idx, 0, start_ms, end_ms, a - w, bound_start_ms, bound_end_ms, disabled FROM s WHERE b > f AND a >= t
  UNION ALL SELECT clip, idx, 0, start_ms, start_ms + (f - a), a, start_ms, start_ms + (f - a), disabled FROM s WHERE b > f AND a < t AND a < f AND f - a >= 50
  UNION ALL SELECT clip, idx, 1, start_ms + (t - a), end_ms, f, start_ms + (t - a), end_ms, disabled FROM s WHERE b > f AND a < t AND b > t AND b - t >= 50)
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY pos_ms, idx, n) - 1 AS idx, start_ms, end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled FROM p
UNION ALL SELECT clip, idx, start_ms, end_ms, pos_ms, bound_start_ms, bound_end_ms, disabled FROM s WHERE clip NOT IN (SELECT clip FROM p)""")
def _(spark, sf):
    reqs = orders(spark, sf, "cast(clip % 3000 AS double) AS from_pos",
                  "cast(clip % 3000 AS double) + CASE WHEN clip % 9 = 0 THEN 0.5D ELSE clip % 2100 END AS to_pos")
    return S.remove_range(segs(spark, sf), reqs)


@query("i4_move_to_gap", f"""WITH {SQL_REQ}, {SQL_TARGETS}, blk AS (SELECT r.*, s.end_ms - s.start_ms AS dur FROM req r JOIN fx_segments s ON s.clip = r.clip AND s.idx = r.index),
o AS (SELECT s.clip, s.idx, s.pos_ms AS a, s.pos_ms + s.end_ms - s.start_ms AS b FROM fx_segments s JOIN blk r ON s.clip = r.clip WHERE s.idx <> r.index),
c AS (SELECT clip, a, coalesce(max(b) OVER (PARTITION BY clip ORDER BY a, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM o),
g AS (SELECT clip, cur AS gs, a AS ge FROM c WHERE a - cur > 0.5
  UNION ALL SELECT k.clip, k.m, greatest(k.m, 9000) FROM (SELECT blk.clip, coalesce(max(o.b), 0) AS m FROM blk LEFT JOIN o ON blk.clip = o.clip GROUP BY blk.clip) k),
best AS (SELECT blk.*, gs AS lo, ge - dur AS hi, greatest(gs, least(desired, ge - dur)) AS pos FROM g JOIN blk ON g.clip = blk.clip WHERE ge - gs >= dur - 0.5
  QUALIFY row_number() OVER (PARTITION BY blk.clip ORDER BY abs(greatest(gs, least(desired, ge - dur)) - desired), gs) = 1),
cand AS (SELECT clip, lo AS at, lo AS edge, -2 AS no FROM best UNION ALL SELECT clip, hi, hi + dur, -1 FROM best
  UNION ALL SELECT t.clip, target, target, 2 * t.no FROM targets t JOIN best b ON t.clip = b.clip
  UNION ALL SELECT t.clip, target - dur, target, 2 * t.no + 1 FROM targets t JOIN best b ON t.clip = b.clip),
st AS (SELECT b.clip, c.at, c.edge FROM best b JOIN cand c ON b.clip = c.clip WHERE c.at >= lo - 0.5 AND c.at <= hi + 0.5 AND abs(c.at - pos) <= 80
  QUALIFY row_number() OVER (PARTITION BY b.clip ORDER BY abs(c.at - pos), c.no DESC) = 1)
SELECT s.clip, s.idx, coalesce(CASE WHEN b.clip IS NOT NULL THEN coalesce(st.at, b.pos) END, s.pos_ms) AS pos_ms, CASE WHEN b.clip IS NOT NULL THEN st.edge END AS snapped_at
FROM fx_segments s LEFT JOIN best b ON s.clip = b.clip AND s.idx = b.index LEFT JOIN st ON st.clip = b.clip""")
def _(spark, sf):
    req = requests(spark, sf).withColumn("extent_ms", F.lit(9000.0)).withColumn("snap_ms", F.lit(80.0))
    return S.move_to(segs(spark, sf), req).select("clip", "idx", "pos_ms", "snapped_at")


@query("i5_toggle", """SELECT s.clip, s.idx, CASE WHEN s.idx = s.clip % 4 AND e.clip IS NOT NULL THEN NOT s.disabled ELSE s.disabled END AS disabled
FROM fx_segments s LEFT JOIN fx_edits e ON s.clip = e.clip""")
def _(spark, sf):
    return S.toggle(segs(spark, sf), orders(spark, sf, "clip % 4 AS index")).select("clip", "idx", "disabled")


@query("i5_remove_one", """WITH n AS (SELECT clip, count(*) AS n FROM fx_segments GROUP BY clip)
SELECT s.clip, row_number() OVER (PARTITION BY s.clip ORDER BY s.idx) - 1 AS idx, s.start_ms FROM fx_segments s JOIN n ON s.clip = n.clip
WHERE NOT (n.n > 1 AND s.idx = s.clip % 4)""")
def _(spark, sf):
    return S.remove_one(segs(spark, sf), orders(spark, sf, "clip % 4 AS index")).select("clip", "idx", "start_ms")


@query("i5_framing", """SELECT clip, idx, CASE WHEN idx = clip % 3 THEN least(1, greatest(0, (clip % 30) / 20.0 - 0.25))::DOUBLE ELSE 0.5::DOUBLE END AS crop_x,
  CASE WHEN idx = clip % 3 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS crop_y FROM fx_segments""")
def _(spark, sf):
    s = segs(spark, sf).withColumn("crop_x", F.lit(0.5)).withColumn("crop_y", F.lit(0.5))
    req = orders(spark, sf, "clip % 3 AS index", "(clip % 30) / 20.0D - 0.25D AS crop_x", "0.25D AS crop_y")
    return S.set_framing(s, req).select("clip", "idx", "crop_x", "crop_y")


@query("i6_blocks_end", "SELECT clip, greatest(0, max(pos_ms + end_ms - start_ms)) AS end_pos FROM fx_segments GROUP BY clip")
def _(spark, sf):
    return S.blocks_end(segs(spark, sf))


@query("i6_sort_by_pos", """SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY (idx * 7 + clip) % 5, idx) - 1 AS idx, start_ms FROM fx_segments""")
def _(spark, sf):
    s = segs(spark, sf).withColumn("pos_ms", F.expr("cast((idx * 7 + clip) % 5 AS double)"))
    return S.sort_by_pos(s).select("clip", "idx", "start_ms")


@query("p24_fill_legacy_segments", """WITH RECURSIVE s AS (SELECT clip, idx, start_ms, end_ms, CASE WHEN (clip + idx) % 3 = 0 THEN pos_ms * 2 END AS pos,
    CASE WHEN idx % 2 = 0 THEN bound_start_ms END AS bs, CASE WHEN idx % 2 = 0 THEN bound_end_ms END AS be FROM fx_segments),
f AS (SELECT clip, idx, start_ms, end_ms, coalesce(pos, 0) AS p, bs, be FROM s WHERE idx = 0
  UNION ALL SELECT s.clip, s.idx, s.start_ms, s.end_ms, coalesce(s.pos, f.p + f.end_ms - f.start_ms), s.bs, s.be FROM f JOIN s ON s.clip = f.clip AND s.idx = f.idx + 1)
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY p, idx) - 1 AS idx, start_ms, end_ms, p AS pos_ms, coalesce(bs, start_ms) AS bound_start_ms, coalesce(be, end_ms) AS bound_end_ms FROM f
UNION ALL SELECT clip, 0, 0, 60000, 0, 0, 60000 FROM fx_edits WHERE clip NOT IN (SELECT clip FROM fx_segments)""")
def _(spark, sf):
    old = segs(spark, sf).withColumns({
        "pos_ms": F.expr("CASE WHEN (clip + idx) % 3 = 0 THEN pos_ms * 2 END"),
        "bound_start_ms": F.expr("CASE WHEN idx % 2 = 0 THEN bound_start_ms END"), "bound_end_ms": F.expr("CASE WHEN idx % 2 = 0 THEN bound_end_ms END"),
        "crop_x": F.lit(None).cast("double"), "crop_y": F.lit(None).cast("double")})
    out = S.fill_segments(old, orders(spark, sf, "60000.0D AS duration_ms"))
    return out.select("clip", "idx", "start_ms", "end_ms", "pos_ms", "bound_start_ms", "bound_end_ms")


@query("p21_track_gain", """SELECT clip, greatest(sys_vol - 0.75, 0) AS sys_gain, CASE WHEN mic_muted THEN 0 ELSE 1 END::DOUBLE AS mic_gain, 1.0::DOUBLE AS other_gain,
  sys_vol = 1 AND NOT mic_muted AS untouched FROM fx_edits""")
def _(spark, sf):
    e = view(spark, sf, "fx_edits")
    mixer = S.flat_mixer(e)
    low = F.create_map(F.lit("sys"), F.struct((F.col("sys_vol") - 0.75).alias("vol"), F.lit(False).alias("muted")))
    return e.select("clip", E.track_gain(low, "sys").alias("sys_gain"), E.track_gain(mixer, "mic").alias("mic_gain"),
                    E.track_gain(mixer, "app").alias("other_gain"), E.mixer_untouched(mixer).alias("untouched"))


@query("p22_is_noop_edit", f"""WITH {SQL_EDITED} SELECT e.clip, d.clip IS NULL AS noop FROM fx_edits e LEFT JOIN edited d ON e.clip = d.clip""")
def _(spark, sf):
    return S.with_noop(view(spark, sf, "fx_edits"), segs(spark, sf)).select("clip", "noop")


@query("p23_is_identity_edit", """WITH s AS (SELECT clip, count(*) AS n, min(start_ms) AS s, max(end_ms) AS e, bool_or(disabled) AS off FROM fx_segments GROUP BY clip),
j AS (SELECT e.clip, c.path, coalesce(e.format_kind = 'horizontal' AND sys_vol = 1 AND NOT mic_muted AND n = 1 AND NOT off AND s.s <= 50 AND s.e >= c.duration_sec * 10 - 50, false) AS identity
  FROM fx_edits e JOIN fx_clips c ON c.clip_no = e.clip LEFT JOIN s ON s.clip = e.clip)
SELECT clip, identity, identity AND lower(path) LIKE '%.mp4' AS original FROM j""")
def _(spark, sf):
    e = view(spark, sf, "fx_edits")
    c = view(spark, sf, "fx_clips").select(F.col("clip_no").alias("clip"), "path", (F.col("duration_sec") / 100).alias("dur"))
    j = e.join(c, "clip").join(S.edit_shape(segs(spark, sf)), "clip", "left")
    identity = E.is_identity(F.col("format_kind"), S.flat_mixer(e), F.col("n"), F.col("first_start"), F.col("last_end"), F.col("any_disabled"), F.col("dur"))
    return j.select("clip", identity.alias("identity"), E.shares_original(text.file_ext(F.col("path")), identity).alias("original"))
