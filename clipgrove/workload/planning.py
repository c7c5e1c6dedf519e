"""Queries of the bitrate and share planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import view
from clipgrove.functions import edits as E, planning as N
from clipgrove.operators.planning import plan_all
from clipgrove.operators.segments import kept, with_noop
from clipgrove.workload import query

SQL_FACTOR = "CASE quality WHEN 'low' THEN 0.06::DOUBLE WHEN 'normal' THEN 0.1::DOUBLE WHEN 'veryhigh' THEN 0.24::DOUBLE WHEN 'ultra' THEN 0.4::DOUBLE ELSE 0.16::DOUBLE END"
SQL_EFPS = "CASE WHEN fps <= 60 THEN fps::DOUBLE ELSE 60 * sqrt(fps / 60.0::DOUBLE) END"
SQL_MEASURED = "greatest(least(greatest(cast(trunc(size_bytes::DOUBLE * 8 / duration_sec) AS bigint) - 320000, 0), 120000000), 500000)"


def clips(spark, sf):
    return view(spark, sf, "fx_clips")


@query("p14_bitrate_model", f"""WITH b AS (SELECT clip_no, least(greatest(cast(trunc((width::BIGINT * height)::DOUBLE * {SQL_EFPS} * {SQL_FACTOR}) AS bigint), 1000000), 150000000) AS bps FROM fx_clips)
SELECT clip_no, bps AS target, least(bps * 7 // 4, 300000000) AS peak FROM b""")
def _(spark, sf):
    c = F.col
    target = N.target_bitrate(c("width"), c("height"), c("fps"), c("quality"))
    return clips(spark, sf).select("clip_no", target.alias("target"), N.peak_bitrate(target).alias("peak"))


@query("p15_estimated_size", f"""WITH b AS (SELECT clip_no, (least(greatest(floor(height * 16 / 9.0::DOUBLE / 2 + 0.5) * 2 * height * {SQL_EFPS} * {SQL_FACTOR}, 1000000), 150000000) + 128000) / 8 * (duration_sec * 20) / 1000000 AS mb FROM fx_clips)
SELECT clip_no, round(mb, 6) AS mb, CASE WHEN mb >= 10000 THEN concat(cast(floor(mb / 1000 + 0.5) AS bigint)::VARCHAR, ' GB') WHEN mb >= 1000 THEN printf('%.1f GB', round(mb / 1000, 1))
  ELSE concat(cast(floor(mb + 0.5) AS bigint)::VARCHAR, ' MB') END AS label FROM b""")
def _(spark, sf):
    c = F.col
    mb = N.estimated_mb(c("height"), c("fps"), c("quality"), c("duration_sec") * 20)
    return clips(spark, sf).select("clip_no", F.round(mb, 6).alias("mb"), N.estimated_label(mb).alias("label"))


@query("p16_output_dims", """WITH t AS (SELECT clip_no, width::BIGINT AS w, height::BIGINT AS h, (clip_no * 37) % 2300 AS t FROM fx_clips)
SELECT clip_no, CASE WHEN t = 0 OR t >= h THEN w ELSE greatest((w * greatest(t - t % 2, 2) // h) // 2 * 2, 2) END AS out_w,
  CASE WHEN t = 0 OR t >= h THEN h ELSE greatest(t - t % 2, 2) END AS out_h FROM t""")
def _(spark, sf):
    d = N.output_dims(F.col("width"), F.col("height"), F.expr("(clip_no * 37) % 2300"))
    return clips(spark, sf).select("clip_no", d["width"].alias("out_w"), d["height"].alias("out_h"))


@query("p17_vertical", f"""WITH t AS (SELECT clip_no, CASE WHEN clip_no % 4 = 0 THEN 1080 ELSE least((clip_no * 31) % 2000, 1080) END // 2 * 2 AS w, width::BIGINT AS sw, height::BIGINT AS sh, {SQL_MEASURED} AS bps FROM fx_clips),
s AS (SELECT *, (w * 16 // 9 + 1) // 2 * 2 AS h FROM t)
SELECT clip_no, w, h, least(greatest(bps * w * h // (sw * sh), 4000000), 40000000) AS bps FROM s""")
def _(spark, sf):
    c = F.col
    size = N.vertical_size(F.expr("CASE WHEN clip_no % 4 = 0 THEN NULL ELSE (clip_no * 31) % 2000 END"))
    bps = N.vertical_bitrate(N.measured_bitrate(c("size_bytes"), c("duration_sec")), c("width"), c("height"), size["width"], size["height"])
    return clips(spark, sf).select("clip_no", size["width"].alias("w"), size["height"].alias("h"), bps.alias("bps"))


@query("p18_measured_bitrate", """WITH t AS (SELECT clip_no, size_bytes, CASE WHEN clip_no % 9 = 0 THEN 0.1 ELSE duration_sec * (clip_no % 5 + 1) / 4 END AS secs FROM fx_clips)
SELECT clip_no, CASE WHEN secs > 0.1 THEN greatest(least(greatest(cast(trunc(size_bytes::DOUBLE * 8 / secs) AS bigint) - 320000, 0), 120000000), 500000) END AS bps FROM t""")
def _(spark, sf):
    secs = F.expr("CASE WHEN clip_no % 9 = 0 THEN 0.1D ELSE duration_sec * (clip_no % 5 + 1) / 4 END")
    return clips(spark, sf).select("clip_no", N.measured_bitrate(F.col("size_bytes"), secs).alias("bps"))


SQL_PLAN = f"""k AS (SELECT clip, sum(CASE WHEN disabled THEN 0 ELSE end_ms - start_ms END) / 1000 AS kept FROM fx_segments GROUP BY clip),
p AS (SELECT c.clip_no, mb, c.size_bytes, c.duration_sec, coalesce(CASE WHEN k.kept > 0 THEN k.kept END, c.duration_sec) AS secs, c.width::BIGINT AS w, c.height::BIGINT AS h, c.fps, {SQL_MEASURED} AS src
  FROM fx_clips c LEFT JOIN k ON k.clip = c.clip_no, (SELECT unnest([10, 50, 100]) AS mb)),
b AS (SELECT *, least(cast(trunc(greatest((mb * 1048576.0::DOUBLE * 8.0 * 0.97::DOUBLE - 128000 * secs) / secs, 300000)) AS bigint), greatest(src, 300000)) AS bps FROM p),
r AS (SELECT b.*, rung FROM b, (SELECT unnest([0, 1080, 720, 480]) AS rung) WHERE rung = 0 OR rung < h),
q AS (SELECT *, CASE WHEN rung = 0 THEN h ELSE rung END AS rh FROM r), z AS (SELECT *, (w * rh // h + 1) // 2 * 2 * rh * fps // 60 <= bps AS ok FROM q),
m AS (SELECT clip_no, mb, coalesce(max(CASE WHEN ok THEN rh END), min(rh)) AS best FROM z GROUP BY 1, 2)"""


def planned(spark, sf):
    c = clips(spark, sf).select("clip_no", "size_bytes", "duration_sec", "width", "height", "fps")
    k = kept(view(spark, sf, "fx_segments")).select(F.col("clip").alias("clip_no"), (F.col("kept_ms") / 1000).alias("kept_sec"))
    return plan_all(c.join(k, "clip_no", "left"))


@query("j27_plan_matrix", f"""WITH {SQL_PLAN} SELECT b.clip_no, b.mb::BIGINT AS preset_mb, b.bps AS bitrate, CASE WHEN m.best < b.h THEN m.best END AS max_height
FROM b JOIN m ON b.clip_no = m.clip_no AND b.mb = m.mb""")
def _(spark, sf):
    return planned(spark, sf).select("clip_no", "preset_mb", "bitrate", "max_height")


@query("p19_share_budget", """WITH t AS (SELECT clip_no, width::BIGINT AS w, height::BIGINT AS h, fps, duration_sec * (clip_no % 13) AS d, 1000000 + clip_no * 9973 AS src FROM fx_clips),
b AS (SELECT *, least(cast(trunc(greatest((26214400.0::DOUBLE * 8.0 * 0.97::DOUBLE - 128000 * greatest(d, 0.1)) / greatest(d, 0.1), 300000)) AS bigint), greatest(src, 300000)) AS bps FROM t),
z AS (SELECT clip_no, bps, h, CASE WHEN rung = 0 THEN h ELSE rung END AS rh, w, fps FROM b, (SELECT unnest([0, 1080, 720, 480]) AS rung) WHERE rung = 0 OR rung < h)
SELECT clip_no, any_value(bps) AS bitrate, CASE WHEN coalesce(max(CASE WHEN (w * rh // h + 1) // 2 * 2 * rh * fps // 60 <= bps THEN rh END), min(rh)) < any_value(h)
  THEN coalesce(max(CASE WHEN (w * rh // h + 1) // 2 * 2 * rh * fps // 60 <= bps THEN rh END), min(rh)) END AS max_height FROM z GROUP BY clip_no""")
def _(spark, sf):
    p = N.share_plan(F.lit(26214400), F.expr("duration_sec * (clip_no % 13)"), F.col("width"), F.col("height"), F.col("fps"), F.expr("1000000 + clip_no * 9973"))
    return clips(spark, sf).select("clip_no", p["bitrate"].alias("bitrate"), p["max_height"].alias("max_height"))


@query("p20_shared_bytes", f"""WITH {SQL_PLAN}, s AS (SELECT clip_no, mb, CASE WHEN duration_sec <= 0 THEN size_bytes::DOUBLE ELSE size_bytes * least(1.0::DOUBLE, secs / duration_sec) END AS sb FROM p)
SELECT clip_no, mb::BIGINT AS preset_mb, round(sb, 3) AS shared_bytes, sb <= mb * 1048576 AS disabled FROM s""")
def _(spark, sf):
    return planned(spark, sf).select("clip_no", "preset_mb", F.round("shared_bytes", 3).alias("shared_bytes"), "disabled")


@query("p29_fingerprint_key", """SELECT clip_no, sha256(concat_ws(chr(31), '=' || path, '=' || cast(modified_ms // 1000 AS string), '=' || quality,
  CASE WHEN clip_no % 3 = 0 THEN '-' ELSE '=' || cast(clip_no % 100 AS string) END, '-')) AS fingerprint FROM fx_clips""")
def _(spark, sf):
    return clips(spark, sf).select("clip_no", N.fingerprint(
        F.col("path"), F.expr("modified_ms div 1000"), F.col("quality"), F.expr("CASE WHEN clip_no % 3 = 0 THEN NULL ELSE clip_no % 100 END"), F.lit(None)).alias("fingerprint"))


@query("p30_audio_plan", """WITH g AS (SELECT clip, list_concat(CASE WHEN clip % 5 <> 0 THEN [sys_vol] ELSE [] END, CASE WHEN clip % 3 = 0 THEN [CASE WHEN mic_muted THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END] ELSE [] END) AS gains,
  clip % 7 = 0 AS mix FROM fx_edits)
SELECT clip, CASE WHEN mix AND len(list_filter(gains, lambda x: abs(x - 1) >= 0.001)) = 0 THEN 'copy' WHEN len(gains) >= 2 THEN 'remix' WHEN len(gains) = 0 THEN 'none'
  WHEN abs(gains[1] - 1) < 0.001 THEN 'copy' ELSE 'gain' END AS plan FROM g""")
def _(spark, sf):
    e = view(spark, sf, "fx_edits")
    none = F.expr("cast(array() AS array<double>)")
    sys = F.when(F.expr("clip % 5 <> 0"), F.array("sys_vol")).otherwise(none)
    mic = F.when(F.expr("clip % 3 = 0"), F.array(F.when(F.col("mic_muted"), 0.0).otherwise(1.0))).otherwise(none)
    return e.select("clip", E.audio_plan(F.concat(sys, mic), F.expr("clip % 7 = 0")).alias("plan"))
