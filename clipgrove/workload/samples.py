"""Queries over PCM samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import table, view
from clipgrove.functions import samples as A
from clipgrove.operators import samples as M
from clipgrove.workload import query


def samples(spark, sf):
    return view(spark, sf, "fx_samples")


def stereo(spark, sf):
    """Two channels, frames ten apart, so that silence lies between."""
    return samples(spark, sf).select("stream_id", "source", F.expr("frame * 10 + source % 10 AS frame"), F.expr("cast(source % 2 AS int) AS ch"), "sample")


I16 = "cast(trunc(least(greatest({x}, -32768::FLOAT), 32767::FLOAT)) AS int)"
CLIP = "CASE WHEN abs({x} / 32768.0::DOUBLE) <= 0.75 THEN {x} / 32768.0::DOUBLE ELSE sign({x}) * (0.75::DOUBLE + 0.25::DOUBLE * (1 - exp(-(abs({x} / 32768.0::DOUBLE) - 0.75::DOUBLE) / 0.25::DOUBLE))) END"


def clip_sql(x: str) -> str:
    return I16.format(x=f"({CLIP.format(x=x)})::FLOAT * 32767::FLOAT")


@query("p27_sample_ops", f"""WITH s AS (SELECT source, frame, sample::FLOAT AS s, (0.3 + source % 7 * 0.2)::FLOAT AS g, sample * 1.7::DOUBLE AS x FROM fx_samples)
SELECT source, frame, {I16.format(x='s * g')} AS gained, {clip_sql('x')} AS clipped,
  cast(round(least(greatest(x / 30000.0::DOUBLE, -1), 1)::FLOAT * 32767::FLOAT) AS int) AS from_float,
  (s + 0.707::FLOAT * (s * 2) + 0.707::FLOAT * (s * 4))::DOUBLE AS l, (-s + 0.707::FLOAT * (s * 2) + 0.707::FLOAT * (s * 5))::DOUBLE AS r FROM s""")
def _(spark, sf):
    s = F.col("sample")
    x = s * F.lit(1.7)
    gain = F.expr("cast(0.3 + source % 7 * 0.2 AS float)")
    six = A.downmix([s, -s, s * 2, s * 3, s * 4, s * 5])
    return samples(spark, sf).select(
        "source", "frame", A.apply_gain(s, gain).alias("gained"), A.soft_clip(x).alias("clipped"), A.from_float(x / 30000.0).alias("from_float"),
        six["l"].cast("double").alias("l"), six["r"].cast("double").alias("r"))


@query("p28_resample_linear", """WITH n AS (SELECT stream_id, source, max(frame) + 1 AS n FROM fx_samples GROUP BY 1, 2),
k AS (SELECT stream_id, source, n, unnest(range(n * 48000 // 44100)) AS k FROM n), p AS (SELECT *, k * 44100.0::DOUBLE / 48000.0::DOUBLE AS pos FROM k),
i AS (SELECT *, least(cast(floor(pos) AS bigint), n - 1) AS i0, least(least(cast(floor(pos) AS bigint), n - 1) + 1, n - 1) AS i1, (pos - floor(pos))::FLOAT AS fr FROM p)
SELECT i.stream_id, i.source, k AS frame, (a.sample::FLOAT + (b.sample::FLOAT - a.sample::FLOAT) * fr)::DOUBLE AS value
FROM i JOIN fx_samples a ON a.stream_id = i.stream_id AND a.source = i.source AND a.frame = i0 JOIN fx_samples b ON b.stream_id = i.stream_id AND b.source = i.source AND b.frame = i1""")
def _(spark, sf):
    return M.resample(samples(spark, sf), 44100, 48000).withColumn("value", F.col("value").cast("double"))


@query("p28_resample_down", """WITH k AS (SELECT stream_id, source, unnest(range(64 * 22050 // 48000)) AS k FROM (SELECT DISTINCT stream_id, source FROM fx_samples)),
i AS (SELECT *, k * 48000.0::DOUBLE / 22050.0::DOUBLE AS pos FROM k)
SELECT i.stream_id, i.source, k AS frame, (a.sample::FLOAT + (b.sample::FLOAT - a.sample::FLOAT) * (pos - floor(pos))::FLOAT)::DOUBLE AS value
FROM i JOIN fx_samples a ON a.stream_id = i.stream_id AND a.source = i.source AND a.frame = floor(pos) JOIN fx_samples b ON b.stream_id = i.stream_id AND b.source = i.source AND b.frame = least(floor(pos) + 1, 63)""")
def _(spark, sf):
    return M.resample(samples(spark, sf), 48000, 22050).withColumn("value", F.col("value").cast("double"))


@query("a8_peaks_fixed", """WITH b AS (SELECT stream_id, source, frame // 12 AS bucket, frame, sample FROM fx_samples WHERE frame // 12 < 5),
p AS (SELECT stream_id, source, bucket, max(abs(sample)) / 32768.0::DOUBLE AS peak FROM b WHERE (frame - bucket * 12) % 3 = 0 GROUP BY 1, 2, 3) SELECT * FROM p""")
def _(spark, sf):
    return M.peaks_fixed(samples(spark, sf), buckets=5, probes=4)


@query("a8_peaks_fixed_wide", """WITH k AS (SELECT DISTINCT stream_id, source FROM fx_samples), g AS (SELECT stream_id, source, unnest(range(1600)) AS bucket FROM k)
SELECT g.stream_id, g.source, bucket, coalesce(abs(sample) / 32768.0::DOUBLE, 0) AS peak FROM g LEFT JOIN fx_samples s ON s.stream_id = g.stream_id AND s.source = g.source AND s.frame = bucket""")
def _(spark, sf):
    return M.peaks_fixed(samples(spark, sf))


@query("a9_peaks_proportional", """WITH g AS (SELECT stream_id, source, n, unnest(range(least(n, 25))) AS b FROM (SELECT stream_id, source, max(frame) + 1 AS n FROM fx_samples GROUP BY 1, 2)),
r AS (SELECT *, b * n // least(n, 25) AS f, greatest((b + 1) * n // least(n, 25), b * n // least(n, 25) + 1) AS t FROM g)
SELECT r.stream_id, r.source, b AS bucket, max(abs(sample)) / 32768.0::DOUBLE AS peak FROM r JOIN fx_samples s ON s.stream_id = r.stream_id AND s.source = r.source AND s.frame >= f AND s.frame < t GROUP BY 1, 2, 3""")
def _(spark, sf):
    return M.peaks_proportional(samples(spark, sf), 25)


SQL_STEREO = "st AS (SELECT stream_id, source, frame * 10 + source % 10 AS frame, cast(source % 2 AS int) AS ch, sample FROM fx_samples)"


@query("a10_mix_by_timestamp", f"""WITH {SQL_STEREO}, g AS (SELECT stream_id, unnest(range(960)) AS frame FROM (SELECT DISTINCT stream_id FROM st)),
gc AS (SELECT g.*, c AS ch FROM g, (SELECT unnest([0, 1]) AS c)), s AS (SELECT stream_id, frame, ch, sum(sample) AS v FROM st GROUP BY 1, 2, 3)
SELECT gc.stream_id, gc.frame // 480 AS block, gc.frame, gc.ch, cast(least(greatest(coalesce(v, 0), -32768), 32767) AS int) AS sample
FROM gc LEFT JOIN s ON s.stream_id = gc.stream_id AND s.frame = gc.frame AND s.ch = gc.ch""")
def _(spark, sf):
    st = stereo(spark, sf)
    upto = st.groupBy("stream_id").agg(F.lit(1000).cast("bigint").alias("upto"))
    return M.mix(st, upto)


@query("a11_weighted_mix", f"""WITH {SQL_STEREO}, x AS (SELECT stream_id, frame, ch, sum(sample * (source % 5 * 0.25::DOUBLE)) AS x FROM st WHERE source % 5 <> 0 GROUP BY 1, 2, 3)
SELECT stream_id, frame, ch, {clip_sql('x')} AS sample FROM x""")
def _(spark, sf):
    st = stereo(spark, sf)
    gains = st.select("stream_id", "source").distinct().withColumn("gain", F.expr("source % 5 * 0.25D"))
    return M.remix(st, gains)


@query("a11_mix_rate", """WITH t AS (SELECT label AS stream_id, vec_id AS ordinal, CASE vec_id % 7 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END AS rate FROM embeddings WHERE label % 3 <> 1 OR vec_id % 7 > 1)
SELECT stream_id, coalesce(arg_min(rate, ordinal) FILTER (WHERE rate IN (44100, 48000)), 48000) AS rate FROM t GROUP BY 1""")
def _(spark, sf):
    t = table(spark, sf, "embeddings").where("label % 3 <> 1 OR vec_id % 7 > 1").select(
        F.col("label").alias("stream_id"), F.col("vec_id").alias("ordinal"), F.expr("CASE vec_id % 7 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END AS rate"))
    return M.remix_rate(t)


@query("f7_audible_tracks", """WITH p AS (SELECT stream_id, CASE WHEN source % 10 = 0 THEN 'mic' ELSE cast(source AS string) END AS source, abs(CASE WHEN source % 4 = 0 THEN sample // 3000 ELSE sample END) / 32768.0 AS peak FROM fx_samples)
SELECT stream_id, source FROM p GROUP BY 1, 2 HAVING max(peak) >= 0.001 OR source = 'mic'""")
def _(spark, sf):
    s = samples(spark, sf).select(
        "stream_id", F.expr("CASE WHEN source % 10 = 0 THEN 'mic' ELSE cast(source AS string) END AS source"),
        F.expr("abs(CASE WHEN source % 4 = 0 THEN sample div 3000 ELSE sample END) / 32768.0D AS peak"))
    return M.audible(s)


def clocked(spark, sf):
    """Packets of 480 frames whose stamps drift, jitter and sometimes jump."""
    return view(spark, sf, "fx_packets").select(
        "stream_id", F.col("track").alias("source"), "seq",
        F.expr("seq * 480 + (seq div 50) * 7 + (seq * 37) % 90 - 45 + CASE WHEN seq % 1500 > 1200 THEN 20000 ELSE 0 END AS stamp"),
        F.expr("CAST(480 + size % 3 * 3000 AS bigint) AS frames"))


@query("w18_clock_cursor", """WITH RECURSIVE p AS (SELECT stream_id, track AS source, seq, seq * 480 + (seq // 50) * 7 + (seq * 37) % 90 - 45 + CASE WHEN seq % 1500 > 1200 THEN 20000 ELSE 0 END AS stamp, 480 + size % 3 * 3000 AS frames,
    row_number() OVER (PARTITION BY stream_id, track ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, source, seq, r, stamp AS place, 0 AS adjust, stamp + frames AS expected FROM p WHERE r = 1
  UNION ALL SELECT stream_id, source, seq, r, place, adjust, place + frames + adjust FROM (SELECT p.stream_id, p.source, p.seq, p.r, p.frames, CASE WHEN abs(p.stamp - f.expected) > 4800 THEN p.stamp ELSE f.expected END AS place,
    CASE WHEN abs(p.stamp - f.expected) > 4800 THEN 0 WHEN p.stamp - f.expected > 48 THEN 1 WHEN p.stamp - f.expected < -48 THEN -1 ELSE 0 END AS adjust
    FROM f JOIN p ON p.stream_id = f.stream_id AND p.source = f.source AND p.r = f.r + 1) x)
SELECT stream_id, source, seq, place, adjust FROM f""")
def _(spark, sf):
    return M.place(clocked(spark, sf)).select("stream_id", "source", "seq", F.col("at").alias("place"), "adjust")
