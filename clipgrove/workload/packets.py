"""Queries over packet streams, frames and sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import table, view
from clipgrove.functions import timebase as T
from clipgrove.operators import packets as P, sampletable as ST, segments as S, stateful as SF
from clipgrove.operators.catalog import ordinal
from clipgrove.workload import query

HOUR = 3600 * T.SECOND
WINDOW = 6 * HOUR
# The test rows are about half an hour apart, so chunks and buckets are a week wide.
WEEK = 7 * 24 * HOUR


def packets(spark, sf):
    return view(spark, sf, "fx_packets")


def frames(spark, sf):
    return view(spark, sf, "fx_frames")


def ms_frames(spark, sf):
    f = P.frame_numbers(frames(spark, sf))
    return f.select("clip", "n", (F.col("t") / 10000).alias("ms"), "key")


SQL_MS = """nf AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t, seq) - 1 AS n, t / 10000 AS ms, key FROM fx_frames)"""
SQL_Q = """q AS (SELECT o_orderkey % 400 AS clip, (o_orderkey * 7919 % 15000)::DOUBLE AS ms, o_orderkey AS id FROM orders)"""


def queries_ms(spark, sf):
    return table(spark, sf, "orders").select(
        F.expr("o_orderkey % 400 AS clip"), F.expr("cast(o_orderkey * 7919 % 15000 AS double) AS ms"), F.col("o_orderkey").alias("id"))


@query("s7_packet_source", "SELECT event_id AS seq, user_id AS stream_id, event_type AS track, value AS size FROM events")
def _(spark, sf):
    from clipgrove.sources.packets import packets as source

    raw = source(spark, f"{sf}/events.parquet")
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("stream_id"), F.col("event_type").alias("track"), F.col("value").alias("size"))


@query("p26_timebase", """SELECT seq, cast((time::HUGEINT * 90000 + 5000000) // 10000000 AS bigint) AS ticks, cast(time::HUGEINT * 10000000 // 90000 AS bigint) AS hns,
  cast(floor((time - 864000000001)::HUGEINT * 48000 / 10000000.0) AS bigint) AS frame, cast(seq * 10000000 // 60 AS bigint) AS pts,
  CASE WHEN time - 1000000000 <= 0 THEN 0 ELSE (time - 1000000000 + 36000000000 // 2) // 36000000000 END AS slot FROM fx_packets""")
def _(spark, sf):
    t = F.col("time")
    return packets(spark, sf).select(
        "seq", T.to_ticks(t, 90000).alias("ticks"), T.to_hns(t, 90000).alias("hns"), T.to_frame(t, F.lit(864000000001)).alias("frame"),
        T.cfr_pts(F.col("seq"), 60).alias("pts"), T.time_slot(t, F.lit(1000000000), 36000000000).alias("slot"))


@query("w2_monotone_starts", """WITH RECURSIVE s AS (SELECT stream_id, seq, time // 100000000000 AS start, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, seq, r, start FROM s WHERE r = 1
  UNION ALL SELECT s.stream_id, s.seq, s.r, CASE WHEN s.start <= f.start THEN f.start + 1 ELSE s.start END FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1)
SELECT stream_id, seq, start FROM f""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", F.expr("time div 100000000000 AS start"))
    return P.monotone(p, ["stream_id"])


@query("w3_durations_from_next", """SELECT stream_id, track, seq, least(coalesce(lead(time // 1000) OVER w - time // 1000, greatest(dur // 1000, 1)), 4294967295) AS dur_ticks
FROM fx_packets WINDOW w AS (PARTITION BY stream_id, track ORDER BY seq)""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "track", "seq", F.expr("time div 1000 AS start"), F.expr("dur div 1000 AS own_dur"))
    return P.durations(p, ["stream_id", "track"]).select("stream_id", "track", "seq", "dur_ticks")


@query("w4_gop_id", "SELECT stream_id, seq, cast(sum(key::INT) OVER (PARTITION BY stream_id ORDER BY seq) AS bigint) AS gop FROM fx_packets WHERE track = 'v'")
def _(spark, sf):
    return P.gop_id(P.video(packets(spark, sf))).select("stream_id", "seq", "gop")


SQL_RING = f"""v AS (SELECT * FROM fx_packets WHERE track = 'v'), l AS (SELECT stream_id, segment, max(time) AS latest FROM v GROUP BY 1, 2),
a AS (SELECT v.stream_id, v.segment, max(seq) AS anchor FROM v JOIN l ON v.stream_id = l.stream_id AND v.segment = l.segment WHERE key AND time <= latest - {WINDOW} GROUP BY 1, 2)"""


@query("w5_ring_retention", f"""WITH {SQL_RING} SELECT v.stream_id, v.segment, seq FROM v LEFT JOIN a ON v.stream_id = a.stream_id AND v.segment = a.segment WHERE anchor IS NULL OR seq >= anchor""")
def _(spark, sf):
    return P.ring(P.video(packets(spark, sf)), WINDOW).select("stream_id", "segment", "seq")


SQL_KEPT = f"""sl AS (SELECT stream_id, seq, time, CASE WHEN time <= b THEN 0 ELSE (time - b + {HOUR // 2}) // {HOUR} END AS slot FROM (
  SELECT *, first_value(time) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM fx_packets WHERE track = 'v')),
kept AS (SELECT * FROM (SELECT *, max(slot) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sl) WHERE top IS NULL OR slot > top)"""


@query("w6_slot_select", f"WITH {SQL_KEPT} SELECT stream_id, seq, slot FROM kept")
def _(spark, sf):
    return P.slot_select(P.video(packets(spark, sf)), HOUR).select("stream_id", "seq", "slot")


@query("w7_gap_fill", f"""WITH {SQL_KEPT}, g AS (SELECT stream_id, seq, slot, lag(slot) OVER w AS a, lag(seq) OVER w AS prev FROM kept WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
e AS (SELECT *, unnest(range(coalesce(a + 1, slot), slot + 1)) AS sl FROM g)
SELECT stream_id, sl AS slot, CASE WHEN slot - 1 - a >= 3 AND sl <= slot - 2 THEN prev ELSE seq END AS source_seq, sl <> slot AS filled, sl * 10000000 // 60 AS pts FROM e""")
def _(spark, sf):
    return P.gap_fill(P.slot_select(P.video(packets(spark, sf)), HOUR), 60)


SQL_CONT = """RECURSIVE s AS (SELECT stream_id, seq, track, key, seg_time AS t, dur, row_number() OVER w AS r, coalesce(segment <> lag(segment) OVER w, false) AS fresh FROM fx_packets WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
f AS (SELECT stream_id, seq, r, 0::BIGINT AS shift, t + dur AS max_end, false AS pending, CASE WHEN track = 'v' AND key THEN t END AS base, CASE WHEN track = 'a' OR key THEN t END AS at FROM s WHERE r = 1
  UNION ALL SELECT stream_id, seq, r, sh, CASE WHEN skip THEN me ELSE greatest(me, t + sh + 0) + 0 END, pend2, CASE WHEN base IS NULL AND NOT skip AND track = 'v' AND key THEN t0 ELSE base END,
    CASE WHEN NOT skip AND (track = 'a' OR base IS NOT NULL OR key) THEN t0 END
  FROM (SELECT s.stream_id, s.seq, s.r, s.track, s.key, s.t + s.dur AS t, f.max_end AS me, f.base,
      CASE WHEN (f.pending OR s.fresh) AND s.track = 'v' AND s.key THEN f.max_end - s.t ELSE f.shift END AS sh,
      s.t + CASE WHEN (f.pending OR s.fresh) AND s.track = 'v' AND s.key THEN f.max_end - s.t ELSE f.shift END AS t0,
      (f.pending OR s.fresh) AND NOT (s.track = 'v' AND s.key) AS skip, (f.pending OR s.fresh) AND NOT (s.track = 'v' AND s.key) AS pend2
    FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1) x),
b AS (SELECT stream_id, max(base) AS base FROM f GROUP BY 1)
SELECT f.stream_id, f.seq, f.at - b.base AS out_time FROM f JOIN b ON f.stream_id = b.stream_id WHERE f.at - b.base >= 0"""


@query("w8_segment_continuity", f"WITH {SQL_CONT}")
def _(spark, sf):
    return P.continuity(packets(spark, sf)).select("stream_id", "seq", "out_time")


SQL_LAID = """fv AS (SELECT stream_id, min(seq) AS first FROM fx_packets WHERE track = 'v' GROUP BY 1),
cuts AS (SELECT p.stream_id, p.time, p.seq FROM fx_packets p JOIN fv ON p.stream_id = fv.stream_id WHERE track = 'v' AND key AND seq <> first),
laid AS (SELECT p.stream_id, p.track, p.seq, p.size, count(c.seq) AS gop FROM fx_packets p LEFT JOIN cuts c ON c.stream_id = p.stream_id AND (c.time < p.time OR (c.time = p.time AND (p.track = 'a' OR c.seq <= p.seq))) GROUP BY 1, 2, 3, 4)"""


@query("j19_gop_interleave", f"WITH {SQL_LAID} SELECT stream_id, track, seq, gop FROM laid")
def _(spark, sf):
    return P.interleave(packets(spark, sf)).select("stream_id", "track", "seq", "gop")


@query("w9_chunk_offsets", f"""WITH {SQL_LAID}, r AS (SELECT stream_id, gop, track, sum(size) AS bytes, count(*) AS samples FROM laid GROUP BY 1, 2, 3),
o AS (SELECT stream_id, gop, track, samples, cast(48 + coalesce(sum(bytes) OVER (PARTITION BY stream_id ORDER BY gop, track DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS off FROM r)
SELECT stream_id, gop, track, off AS offset, samples, max(off) OVER (PARTITION BY stream_id, track) > 4294967295 AS wide FROM o""")
def _(spark, sf):
    return P.chunk_offsets(P.interleave(packets(spark, sf)), 48)


@query("w13_change_only", "SELECT stream_id, seq, track FROM fx_packets QUALIFY lag(track) OVER (PARTITION BY stream_id ORDER BY seq) IS DISTINCT FROM track")
def _(spark, sf):
    return P.changes(packets(spark, sf), "track").select("stream_id", "seq", "track")


@query("w14_throttle_first", """WITH RECURSIVE s AS (SELECT stream_id, seq, time, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, seq, r, time AS last, true AS ok FROM s WHERE r = 1
  UNION ALL SELECT s.stream_id, s.seq, s.r, CASE WHEN s.time - f.last >= 50000000000 THEN s.time ELSE f.last END, s.time - f.last >= 50000000000 FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1)
SELECT stream_id, seq FROM f WHERE ok""")
def _(spark, sf):
    return SF.throttle(packets(spark, sf).select("stream_id", "seq", "time"), ["stream_id"], "time", 50000000000).select("stream_id", "seq")


@query("w15_anchored_rate_limit", """WITH RECURSIVE s AS (SELECT n, epoch_ms(CAST(substr(line, 1, 23) AS TIMESTAMP)) AS ms, row_number() OVER (ORDER BY n) AS r FROM fx_logs),
f AS (SELECT n, r, ms AS opened, 1 AS sent FROM s WHERE r = 1
  UNION ALL SELECT s.n, s.r, CASE WHEN s.ms - f.opened > 10800000 THEN s.ms ELSE f.opened END, CASE WHEN s.ms - f.opened > 10800000 THEN 1 ELSE f.sent + 1 END FROM f JOIN s ON s.r = f.r + 1)
SELECT n FROM f WHERE sent <= 20""")
def _(spark, sf):
    logs = view(spark, sf, "fx_logs").select(
        "n", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(substr(line, 1, 23) AS timestamp_ntz)) AS ms"), F.lit("ui").alias("source"))
    return SF.rate_limit(logs, ["source"], "ms", 10800000, 20, "n").select("n")


@query("u10_upsert_seen", """WITH RECURSIVE b AS (SELECT user_id AS name, event_id AS seq, epoch_us(ts) // 1000000 AS sec FROM events),
s AS (SELECT name, sec, seq, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM (SELECT name, seq, sec FROM b UNION ALL SELECT user_id, -1, epoch_us(min(ts)) // 1000000 + 40000 FROM events WHERE user_id % 3 = 0 GROUP BY 1)),
f AS (SELECT name, r, sec AS last, seq FROM s WHERE r = 1
  UNION ALL SELECT s.name, s.r, CASE WHEN s.sec - f.last >= 86400 THEN s.sec ELSE f.last END, CASE WHEN s.sec - f.last >= 86400 THEN s.seq ELSE f.seq END FROM f JOIN s ON s.name = f.name AND s.r = f.r + 1)
SELECT cast(name AS string) AS name, arg_max(seq, r) AS appid, max(last) AS last_seen FROM f GROUP BY name""")
def _(spark, sf):
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000000"
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("appid"), F.expr(f"{us} AS at"), F.col("event_id").alias("seq"))
    seen = e.where("cast(name AS bigint) % 3 = 0").groupBy("name").agg((F.min("at") + 40000).alias("last_seen")).withColumn("appid", F.lit(-1).cast("bigint"))
    return SF.upsert_seen(seen, e, 86400)


@query("w16_inactivity", f"""WITH a AS (SELECT stream_id, seq, time, track = 'a' AS active FROM fx_packets)
SELECT stream_id, seq, NOT active AND time - coalesce(max(CASE WHEN active THEN time END) OVER w, min(time) OVER w) >= {2 * HOUR} AS away FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
def _(spark, sf):
    return P.away(packets(spark, sf).withColumn("active", F.expr("track = 'a'")), 2 * HOUR).select("stream_id", "seq", "away")


@query("w19_split_parts", """WITH s AS (SELECT stream_id, segment, arg_min(width, seq) AS width, coalesce(string_agg(DISTINCT CASE WHEN track <> 'v' THEN track END, ','), '') AS layout FROM fx_packets GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(width) OVER w <> width OR lag(layout) OVER w <> layout THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY segment))
SELECT stream_id, segment, width::BIGINT AS width, layout, cast(sum(ch) OVER (PARTITION BY stream_id ORDER BY segment) AS bigint) AS part FROM c""")
def _(spark, sf):
    return P.split_parts(packets(spark, sf)).withColumn("width", F.col("width").cast("bigint"))


@query("w20_keyframe_sampling", """WITH k AS (SELECT clip, t FROM fx_frames WHERE key), l AS (SELECT clip, max(t) AS dur FROM fx_frames GROUP BY clip),
g AS (SELECT clip, unnest(range(0, greatest(dur, 1), greatest(dur // 120, 10000000))) AS target FROM l),
h AS (SELECT DISTINCT g.clip, k.t AS tile FROM g ASOF JOIN k ON g.clip = k.clip AND g.target >= k.t),
r AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY tile) - 1 AS i, tile FROM h)
SELECT clip, i, tile, i % 16 AS col, i // 16 AS row FROM r""")
def _(spark, sf):
    f = frames(spark, sf)
    return P.sample_keyframes(f.where("key"), f.groupBy("clip").agg(F.max("t").alias("dur")), 120)


@query("w22_frame_step", f"""WITH {SQL_MS}, {SQL_Q}, n AS (SELECT *, lead(ms) OVER (PARTITION BY clip ORDER BY n) AS nxt, max(n) OVER (PARTITION BY clip) AS last FROM nf),
k AS (SELECT q.id, q.clip, (SELECT count(*) FROM nf WHERE nf.clip = q.clip AND nf.ms <= q.ms + 0.001) - 1 AS frame FROM q),
s AS (SELECT k.id, n.* FROM k JOIN n ON n.clip = k.clip AND n.n = greatest(0, least(n.last, greatest(frame, 0) + 1)))
SELECT q.id, round(CASE WHEN s.last >= 1 THEN s.ms + least(1.5, (coalesce(s.nxt, s.ms + 16) - s.ms) * 0.25) END, 6) AS target_ms FROM q LEFT JOIN s ON s.id = q.id""")
def _(spark, sf):
    out = P.frame_step(queries_ms(spark, sf), ms_frames(spark, sf), 1, 16.0)
    return out.select("id", F.round("target_ms", 6).alias("target_ms"))


@query("w23_inactive_fill", f"""WITH iv AS (SELECT stream_id, r.at AS f, r.at + {HOUR} AS t FROM fx_requests r), cov AS (SELECT p.*, iv.t AS til FROM fx_packets p ASOF LEFT JOIN iv ON p.stream_id = iv.stream_id AND p.time >= iv.f),
real AS (SELECT stream_id, time, seq, key, false AS filler FROM cov WHERE til IS NULL OR time >= til),
fill AS (SELECT stream_id, time, -1 AS seq, time = f AS key, true AS filler FROM (SELECT stream_id, f, unnest(range(f, t, 6000000000)) AS time FROM iv)),
u AS (SELECT * FROM real UNION ALL SELECT * FROM fill)
SELECT stream_id, time, seq, key OR (NOT filler AND coalesce(lag(filler) OVER (PARTITION BY stream_id ORDER BY time, seq), false)) AS key, filler FROM u""")
def _(spark, sf):
    iv = view(spark, sf, "fx_requests").select("stream_id", F.col("at").alias("from_time"), (F.col("at") + HOUR).alias("to_time"))
    return P.inactive_fill(packets(spark, sf), iv, 6000000000)


@query("j13_asof_backward", f"""WITH {SQL_MS}, {SQL_Q} SELECT q.id, coalesce(f.n, -1) AS frame FROM q ASOF LEFT JOIN nf f ON q.clip = f.clip AND q.ms + 0.001 >= f.ms""")
def _(spark, sf):
    return P.asof_frame(queries_ms(spark, sf), ms_frames(spark, sf)).select("id", "frame")


@query("j14_nearest_frame", f"""WITH {SQL_MS}, {SQL_Q} SELECT q.id, arg_min(n, struct_pack(a := abs(nf.ms - q.ms), b := nf.ms, c := -n)) AS frame FROM q LEFT JOIN nf ON q.clip = nf.clip GROUP BY q.id""")
def _(spark, sf):
    return P.nearest_frame(queries_ms(spark, sf), ms_frames(spark, sf)).select("id", "frame")


@query("j15_keyframe_band_check", f"""WITH {SQL_MS}, d AS (SELECT s.clip, s.idx, s.end_ms <= s.start_ms AS hollow, min(abs(k.ms - s.start_ms)) AS dist
  FROM fx_segments s LEFT JOIN (SELECT * FROM nf WHERE key) k ON k.clip = s.clip GROUP BY 1, 2, 3)
SELECT clip, bool_and(coalesce(hollow OR dist <= 500.0 / 1, false) AND dist IS NOT NULL) AS on_keyframes FROM d GROUP BY clip""")
def _(spark, sf):
    return P.cuts_on_keyframes(view(spark, sf, "fx_segments"), ms_frames(spark, sf).where("key"), F.lit(1))


SQL_OFFS = """offs AS (SELECT clip, idx, cast(start_ms * 10000 AS bigint) AS s, cast(end_ms * 10000 AS bigint) AS e,
  cast(start_ms * 10000 - coalesce(sum((end_ms - start_ms) * 10000) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS shift FROM fx_segments WHERE NOT disabled),
cut AS (SELECT f.clip, f.seq, f.key, f.t, o.idx, f.t - o.shift AS out_t FROM fx_frames f JOIN offs o ON f.clip = o.clip AND f.t >= o.s - 83333 AND f.t < o.e WHERE o.e > o.s)"""


def cut(spark, sf):
    return P.cut_retime(frames(spark, sf), S.segment_offsets(view(spark, sf, "fx_segments")), 166666)


@query("j16_cut_and_retime", f"WITH {SQL_OFFS} SELECT clip, seq, idx, out_t FROM cut")
def _(spark, sf):
    return cut(spark, sf).select("clip", "seq", "idx", "out_t")


@query("j16_opens_on_keyframe", f"WITH {SQL_OFFS}, p AS (SELECT clip, idx, arg_min(key, struct_pack(a := t, b := seq)) AS k FROM cut GROUP BY 1, 2) SELECT clip, bool_and(k) AS ok FROM p GROUP BY 1")
def _(spark, sf):
    return P.opens_on_keyframe(cut(spark, sf))


@query("p30_export_decision", f"""WITH {SQL_MS}, d AS (SELECT s.clip, s.idx, min(abs(k.ms - s.start_ms)) AS dist FROM fx_segments s LEFT JOIN (SELECT * FROM nf WHERE key) k ON k.clip = s.clip GROUP BY 1, 2),
k AS (SELECT clip, bool_and(coalesce(dist <= 500.0, false)) AS ok FROM d GROUP BY clip),
e AS (SELECT e.clip, list_filter([CASE WHEN e.clip % 13 = 0 THEN 'not_h264' END, CASE WHEN e.clip % 11 = 0 THEN 'watermark' END, CASE WHEN format_kind = 'vertical' THEN 'vertical' END,
  CASE WHEN brightness >= 0.0001 THEN 'look' END, CASE WHEN e.clip % 17 = 0 THEN 'target_bitrate' END, CASE WHEN e.clip % 19 = 0 THEN 'rescaled' END, CASE WHEN e.clip % 23 = 0 THEN 'out_of_order' END],
  lambda x: x IS NOT NULL) AS why, coalesce(k.ok, false) AS ok FROM fx_edits e LEFT JOIN k ON k.clip = e.clip)
SELECT clip, len(why) = 0 AND ok AS copy, CASE WHEN len(why) > 0 THEN array_to_string(why, ', ') WHEN NOT ok THEN 'off_keyframe' ELSE '' END AS reasons FROM e""")
def _(spark, sf):
    from clipgrove.functions import edits as E

    keys = P.cuts_on_keyframes(view(spark, sf, "fx_segments"), ms_frames(spark, sf).where("key"), F.lit(1))
    e = view(spark, sf, "fx_edits").join(keys, "clip", "left")
    d = E.export_decision(
        F.expr("clip % 13 <> 0"), F.expr("clip % 11 = 0"), F.col("format_kind") == "vertical", ~E.look_neutral(F.col("brightness")),
        F.expr("clip % 17 = 0"), F.expr("clip % 19 = 0"), F.expr("clip % 23 <> 0"), F.coalesce("on_keyframes", F.lit(False)))
    return e.withColumn("d", d).select("clip", "d.copy", "d.reasons")


SQL_REPLAY = f"""v AS (SELECT * FROM fx_packets WHERE track = 'v'), now AS (SELECT r.*, v.segment, v.time AS latest FROM fx_requests r ASOF JOIN v ON r.stream_id = v.stream_id AND r.at >= v.time),
b AS (SELECT n.*, coalesce((SELECT max(time) FROM v WHERE key AND v.stream_id = n.stream_id AND v.segment = n.segment AND time <= latest - {WINDOW}),
  (SELECT min(time) FROM v WHERE key AND v.stream_id = n.stream_id AND v.segment = n.segment)) AS base FROM now n)"""


@query("j20_replay_snapshot", f"""WITH {SQL_REPLAY} SELECT b.request_id, p.seq, p.track, p.time - base AS out_time FROM b JOIN fx_packets p
  ON p.stream_id = b.stream_id AND p.segment = b.segment AND p.time >= base AND p.time <= b.at""")
def _(spark, sf):
    return P.replay(view(spark, sf, "fx_requests"), packets(spark, sf), WINDOW, columns=["seq", "track"])


@query("j21_attach_recording", f"""WITH v AS (SELECT * FROM fx_packets WHERE track = 'v'), now AS (SELECT r.*, v.segment FROM fx_requests r ASOF JOIN v ON r.stream_id = v.stream_id AND r.at >= v.time),
b AS (SELECT n.*, (SELECT max(time) FROM v WHERE key AND v.stream_id = n.stream_id AND v.segment = n.segment AND time <= n.at) AS base FROM now n)
SELECT b.request_id, p.seq, p.track, p.time - base AS out_time FROM b JOIN fx_packets p ON p.stream_id = b.stream_id AND p.time >= base AND p.time < b.at + {12 * HOUR}""")
def _(spark, sf):
    req = view(spark, sf, "fx_requests").withColumn("stop", F.col("at") + 12 * HOUR)
    return P.record(req, packets(spark, sf), columns=["seq", "track"])


@query("j30_fifo_pairing", """WITH i AS (SELECT stream_id, time, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM fx_packets WHERE track = 'v' AND NOT key),
o AS (SELECT stream_id, seq, time, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM fx_packets)
SELECT o.stream_id, o.seq, coalesce(i.time, o.time) AS time FROM o LEFT JOIN i ON o.stream_id = i.stream_id AND o.n = i.n""")
def _(spark, sf):
    p = packets(spark, sf)
    return P.pair_fifo(p.where("track = 'v' AND NOT key"), p.select("stream_id", "seq", "time"))


@query("a7_fps_from_gaps", """WITH h AS (SELECT stream_id, time // 30000 AS time FROM fx_packets QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq) <= 32),
g AS (SELECT stream_id, time - lag(time) OVER (PARTITION BY stream_id ORDER BY time) AS gap FROM h), n AS (SELECT stream_id, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap > 0)) AS d FROM g GROUP BY 1)
SELECT stream_id, CASE WHEN n >= 3 AND len(d) > 0 THEN greatest(cast(round(10000000.0::DOUBLE / d[len(d) // 2 + 1]) AS bigint), 1) END AS fps FROM n""")
def _(spark, sf):
    return P.fps_from_gaps(packets(spark, sf).withColumn("time", F.expr("time div 30000")))


@query("a15_run_length_encode", """WITH c AS (SELECT stream_id, seq, size % 3 AS value, CASE WHEN lag(size % 3) OVER w IS DISTINCT FROM size % 3 THEN 1 ELSE 0 END AS ch FROM fx_packets WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM c)
SELECT stream_id, cast(run - 1 AS bigint) AS run, min(seq) AS first, count(*) AS n, min(value) AS value FROM r GROUP BY stream_id, run""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", F.expr("size % 3 AS value"))
    return ST.rle(p, ["stream_id"], "value")


SQL_EDITLIST = """el AS (SELECT o_orderkey AS clip, k AS i, o_custkey AS dur, CASE WHEN k = 0 THEN -1 WHEN k = 1 AND o_orderkey % 5 = 0 THEN -1 WHEN o_orderkey % 11 = 0 AND k = 2 THEN 5 ELSE 0 END AS media_time, o_orderkey
  FROM orders, (SELECT unnest(range(3)) AS k) WHERE o_orderkey % 3 <> 0 AND (k < 2 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0)),
eo AS (SELECT clip, count(*) FILTER (WHERE media_time NOT IN (-1, 0)) = 0 AND count(*) FILTER (WHERE media_time = 0) <= 1 AS ok, sum(CASE WHEN media_time = -1 THEN dur * 10000 ELSE 0 END) AS off FROM el GROUP BY clip)"""


@query("a16_run_length_expand", f"""WITH {SQL_EDITLIST}, r AS (SELECT clip, i, n, delta, coalesce(sum(n::BIGINT * delta) OVER w, 0) AS t0, coalesce(sum(n) OVER w, 0) AS s0 FROM fx_runs
  WINDOW w AS (PARTITION BY clip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT clip, s0, t0, delta, unnest(range(n)) AS k FROM r), t AS (SELECT clip, s0 + k AS sample, (t0 + k * delta) * 10000000 // 90000 AS t FROM x)
SELECT t.clip, count(*) AS samples, cast(max(sample) AS bigint) AS last_sample, cast(sum(t + coalesce(off, 0)) AS bigint) AS sum_t, cast(max(t + coalesce(off, 0)) AS bigint) AS last_t
FROM t LEFT JOIN eo ON eo.clip = t.clip WHERE coalesce(ok, true) GROUP BY t.clip""")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    edits = o.where("i < 2 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0").select(
        F.col("o_orderkey").alias("clip"), "i", F.col("o_custkey").alias("dur"),
        F.expr("CASE WHEN i = 0 THEN -1 WHEN i = 1 AND o_orderkey % 5 = 0 THEN -1 WHEN o_orderkey % 11 = 0 AND i = 2 THEN 5 ELSE 0 END AS media_time"))
    t = ST.expand_runs(view(spark, sf, "fx_runs"), 90000, edits)
    return t.groupBy("clip").agg(F.count(F.lit(1)).alias("samples"), F.max("sample").alias("last_sample"), F.sum("t").alias("sum_t"), F.max("t").alias("last_t"))


SQL_SAMPLES = """x AS (SELECT clip, i, n, coalesce(sum(n) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, unnest(range(n)) AS k FROM fx_runs),
smp AS (SELECT clip, i + 1 AS chunk, s0 + k AS sample, (s0 + k) % 7 + 1 AS size FROM x)"""


@query("j24_chunk_map_join", f"""WITH {SQL_SAMPLES}, o AS (SELECT clip, chunk, sample, size, chunk * 100000 + coalesce(sum(size) OVER (PARTITION BY clip, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM smp)
SELECT clip, count(*) AS samples, cast(sum(off) AS bigint) AS sum_offset, cast(max(off) AS bigint) AS last_offset, cast(sum(chunk * sample) AS bigint) AS mix FROM o WHERE clip % 9 <> 0 GROUP BY clip""")
def _(spark, sf):
    """Chunks follow the runs; clips divisible by nine miss a chunk and are rejected."""
    runs = view(spark, sf, "fx_runs").select("clip", "i", F.col("n").cast("bigint").alias("n"))
    chunks = runs.select("clip", (F.col("i") + 1).alias("chunk"), ((F.col("i") + 1) * 100000).alias("offset")).where("clip % 9 <> 0 OR chunk > 1")
    cmap = runs.select("clip", (F.col("i") + 1).alias("first"), F.col("n").alias("per_chunk"))
    total = runs.groupBy("clip").agg(F.sum("n").alias("n"))
    sizes = total.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select("clip", "sample", (F.col("sample") % 7 + 1).alias("size"))
    out = ST.samples_with_offsets(chunks, cmap, sizes)
    return out.groupBy("clip").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("offset").alias("sum_offset"), F.max("offset").alias("last_offset"), F.sum(F.col("chunk") * F.col("sample")).alias("mix"))


@query("j25_sync_join", """WITH n AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t, seq) AS number, t, key FROM fx_frames)
SELECT clip, number - 1 AS sample, t FROM n WHERE clip % 4 = 0 OR (clip % 4 <> 3 AND key)""")
def _(spark, sf):
    f = P.frame_numbers(frames(spark, sf)).select("clip", F.col("n").alias("sample"), "t", "key")
    sync = f.where("clip % 4 <> 0 AND key").select("clip", (F.col("sample") + F.expr("CASE WHEN clip % 4 = 3 THEN 100000 ELSE 1 END")).alias("number"))
    return ST.keyframes(f.select("clip", "sample", "t"), sync, f.where("clip % 4 <> 0").select("clip"))


@query("a13_fragment_end", """WITH f AS (SELECT clip, i // 2 AS fragment, min(i) * 50000 + sum(CASE WHEN i % 3 = 0 THEN n * delta ELSE 3000 END) AS e FROM fx_runs GROUP BY 1, 2)
SELECT clip, cast(max(e) AS bigint) AS end_ticks, round(max(e) / 90000.0::DOUBLE, 6) AS seconds FROM f GROUP BY clip""")
def _(spark, sf):
    frags = view(spark, sf, "fx_runs").select(
        "clip", F.expr("i div 2 AS fragment"), F.expr("(i - i % 2) * 50000 AS base"),
        F.expr("CASE WHEN i % 3 = 0 THEN CAST(n AS bigint) * delta END AS dur"), F.lit(3000).cast("bigint").alias("default_dur"))
    return ST.fragment_duration(frags, F.lit(90000.0)).withColumn("seconds", F.round("seconds", 6))


SQL_TABLE = """RECURSIVE s AS (SELECT stream_id, track, cast((time::HUGEINT * 48000 + 5000000) // 10000000 AS bigint) AS start, greatest(dur * 48000 // 10000000, 1) AS own, row_number() OVER (PARTITION BY stream_id, track ORDER BY seq) AS r FROM fx_packets),
tab AS (SELECT stream_id, track, arg_max(start + own, r) AS e, min(start) AS a FROM s GROUP BY 1, 2)"""


@query("a14_movie_duration", f"WITH {SQL_TABLE} SELECT stream_id, cast(max((e::HUGEINT * 1000 + 24000) // 48000) AS bigint) AS duration_ms FROM tab GROUP BY 1")
def _(spark, sf):
    return P.movie_duration(P.track_table(packets(spark, sf), 48000), 48000)


@query("a22_track_presentation", f"""WITH {SQL_TABLE}, m AS (SELECT stream_id, track, cast((a::HUGEINT * 1000 + 24000) // 48000 AS bigint) AS d, cast(((e - a)::HUGEINT * 1000 + 24000) // 48000 AS bigint) AS m FROM tab)
SELECT stream_id, track, d AS delay_ms, m AS media_ms, d + m AS presented_ms, d > 0 AS empty_edit FROM m""")
def _(spark, sf):
    return P.track_presentation(P.track_table(packets(spark, sf), 48000), 48000)


@query("a17_order_check", """WITH t AS (SELECT stream_id, seq, CASE WHEN stream_id % 3 = 0 AND seq % 1000 = 7 THEN 0 ELSE time END AS time FROM fx_packets),
l AS (SELECT stream_id, time < lag(time) OVER (PARTITION BY stream_id ORDER BY seq) AS back FROM t) SELECT stream_id, NOT coalesce(bool_or(back), false) AS in_order FROM l GROUP BY 1""")
def _(spark, sf):
    return P.in_order(packets(spark, sf).withColumn("time", F.expr("CASE WHEN stream_id % 3 = 0 AND seq % 1000 = 7 THEN 0 ELSE time END")))


@query("a19_recording_stats", """WITH g AS (SELECT stream_id, segment, arg_min(time, seq) FILTER (WHERE track = 'v') AS a, arg_max(time + dur, seq) FILTER (WHERE track = 'v') AS e,
  count(*) FILTER (WHERE track = 'v') AS frames, cast(sum(size) AS bigint) AS bytes, count(DISTINCT track) AS tracks, count(*) FILTER (WHERE track = 'v' AND key) AS keyframes FROM fx_packets GROUP BY 1, 2)
SELECT stream_id, segment, (e - a) / 10000000.0::DOUBLE AS seconds, frames, bytes, tracks, keyframes FROM g""")
def _(spark, sf):
    return P.recording_stats(packets(spark, sf))


@query("a20_audio_window", f"""WITH a AS (SELECT *, max(time) OVER (PARTITION BY stream_id, segment) AS latest FROM fx_packets WHERE track = 'a')
SELECT stream_id, segment, seq FROM a WHERE time > latest - ({WINDOW} + 10000000 + 5000000)""")
def _(spark, sf):
    return P.audio_retention(packets(spark, sf).where("track = 'a'"), WINDOW, 60).select("stream_id", "segment", "seq")


@query("p34_track_layout", """WITH t AS (SELECT clip, i AS file_no, CASE WHEN clip % 3 = 0 THEN NULL WHEN i = 0 THEN 'mix' WHEN i % 3 = 2 THEN NULL ELSE concat('app', cast(i AS string)) END AS id, concat('n', cast(i AS string)) AS name, n - 10 AS samples FROM fx_runs),
u AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY file_no DESC) - 1 AS ordinal, bool_or(id IS NOT NULL) OVER (PARTITION BY clip) AS named, count(*) OVER (PARTITION BY clip) AS n FROM t WHERE samples > 0)
SELECT clip, file_no AS place, id AS track_id, name, ordinal, id = 'mix' AS mix FROM u WHERE named AND id IS NOT NULL
UNION ALL SELECT clip, CASE WHEN n = 1 THEN 0 ELSE 1 - ordinal END, CASE WHEN n = 1 OR ordinal = 1 THEN 'sys' ELSE 'mic' END, '', ordinal, false FROM u WHERE NOT named AND ordinal <= 1""")
def _(spark, sf):
    t = view(spark, sf, "fx_runs").select(
        "clip", F.col("i").alias("file_no"), F.expr("CASE WHEN clip % 3 = 0 THEN NULL WHEN i = 0 THEN 'mix' WHEN i % 3 = 2 THEN NULL ELSE concat('app', cast(i AS string)) END AS id"),
        F.expr("concat('n', cast(i AS string)) AS name"), F.expr("n - 10 AS samples"))
    return P.track_layout(t)


@query("t6_recent_first", """WITH s AS (SELECT cast(user_id AS string) AS name, max(epoch_us(ts) // 1000000) AS last_seen FROM events GROUP BY 1)
SELECT name, last_seen, row_number() OVER (ORDER BY last_seen DESC, name) - 1 AS place FROM s""")
def _(spark, sf):
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000000"
    seen = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max(F.expr(us)).alias("last_seen"))
    return ordinal(seen, P.recent(seen), "place")


@query("w19_resize_tolerance", """WITH RECURSIVE s AS (SELECT stream_id, seq, 1280 + seq * 37 % 29 + seq // 200 % 30 AS w, 720 + seq // 300 % 50 AS h, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, seq, r, w AS uw, h AS uh, true AS rebuild FROM s WHERE r = 1
  UNION ALL SELECT stream_id, seq, r, CASE WHEN hit THEN w ELSE uw END, CASE WHEN hit THEN h ELSE uh END, hit FROM (
    SELECT s.*, f.uw, f.uh, abs(s.w - f.uw) > 16 OR abs(s.h - f.uh) > 16 AS hit FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1) x)
SELECT stream_id, seq, rebuild FROM f""")
def _(spark, sf):
    sizes = packets(spark, sf).select(
        "stream_id", "seq", F.expr("1280 + seq * 37 % 29 + seq div 200 % 30 AS width"), F.expr("720 + seq div 300 % 50 AS height"))
    return SF.resize_rebuilds(sizes, ["stream_id"]).select("stream_id", "seq", "rebuild")
