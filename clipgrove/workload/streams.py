"""Streaming operators over the given tables, fed in arrival steps; their SQL is that of the batch
operator they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clipgrove.fixtures import table, view
from clipgrove.streaming import operators as R
from clipgrove.sources.packets import PACKETS, packets as packet_source
from clipgrove.streaming.drive import run_sink, run_steps, scratch
from clipgrove.workload import query
from clipgrove.workload.packets import HOUR, SQL_CONT, SQL_KEPT, SQL_REPLAY, WINDOW

STEPS = 2


def stepped(df: DataFrame, order: str, by: DataFrame | None = None) -> DataFrame:
    """Adds ``step``: the first and the second half of the arrival order, cut at a segment."""
    top = df.agg((F.max(order) + 1).alias("_top"), F.lit(1).alias("_one"))
    half = F.floor(F.col("_top") / (2500 * STEPS)).cast("bigint") * 2500
    half = F.when(half > 0, half).otherwise(F.floor(F.col("_top") / STEPS))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn(
        "step", F.when(F.col(order) < half, 0).otherwise(1)).drop("_one", "_top")


def packets(spark, sf):
    return view(spark, sf, "fx_packets")


@query("s7_packet_stream", "SELECT stream_id, segment, track, seq, time, dur, key, size, width FROM fx_packets")
def _(spark, sf):
    """Packet files followed as a stream of at most four files a batch; a second run picks up the files that came after the first."""
    root = scratch(spark, "follow")
    rows = stepped(packets(spark, sf), "seq")
    for step in range(STEPS):
        rows.where(f"step = {step}").select(*PACKETS.names).write.mode("append").parquet(f"{root}/in")
        sink = packet_source(spark, f"{root}/in", streaming=True, files_per_trigger=4).writeStream.format("parquet").option("path", f"{root}/out")
        sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PACKETS).parquet(f"{root}/out")


@query("r1_ring_state", f"""WITH {SQL_REPLAY} SELECT b.stream_id, b.request_id, p.seq, p.track, p.time - base AS out_time FROM b JOIN fx_packets p
  ON p.stream_id = b.stream_id AND p.segment = b.segment AND p.time >= base AND p.time <= b.at""")
def _(spark, sf):
    """Rows and requests arrive in the order of time."""
    p = packets(spark, sf).select("stream_id", "segment", "track", "seq", "time", "key", F.lit(None).cast("bigint").alias("request_id"))
    none = F.lit(None)
    r = view(spark, sf, "fx_requests").select(
        "stream_id", none.cast("bigint").alias("segment"), none.cast("string").alias("track"), F.col("request_id").alias("seq"),
        F.col("at").alias("time"), none.cast("boolean").alias("key"), "request_id")

    def build(df):
        saves = df.where("request_id IS NOT NULL").select("request_id", "stream_id", F.col("time").alias("at"))
        return R.ring_stream(df.where("request_id IS NULL"), saves, WINDOW)

    return run_steps(stepped(p.unionByName(r), "time"), "step", STEPS, build, "ring")


@query("r2_mix_stream", """WITH s AS (SELECT stream_id, frame * 480 + stream_id * 480000 AS frame, cast(source % 2 AS int) AS ch, sample FROM fx_samples)
SELECT stream_id, frame, ch, cast(least(greatest(sum(sample), -32768), 32767) AS int) AS sample FROM s GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Every stream starts ten seconds of frames after the one before; odd streams begin in the second step, and each is ended in a third."""
    s = view(spark, sf, "fx_samples").select("stream_id", F.expr("frame * 480 + stream_id * 480000 AS frame"), F.expr("cast(source % 2 AS int) AS ch"), "sample",
                                             F.expr("CASE WHEN frame < 32 AND stream_id % 2 = 0 THEN 0 ELSE 1 END AS step"))
    ends = s.groupBy("stream_id").agg(F.max("frame").alias("frame")).select("stream_id", "frame", F.lit(0).alias("ch"), F.lit(None).cast(s.schema["sample"].dataType).alias("sample"), F.lit(2).alias("step"))
    return run_steps(s.unionByName(ends), "step", 3, R.mix_stream, "mix")


@query("r3_slot_dedup_stream", f"WITH {SQL_KEPT} SELECT stream_id, seq, slot FROM kept")
def _(spark, sf):
    p = packets(spark, sf).where("track = 'v'").select("stream_id", "seq", "time")
    return run_steps(stepped(p, "seq"), "step", STEPS, lambda df: R.slot_stream(df, HOUR), "slots").select("stream_id", "seq", "slot")


@query("r4_stall_fill_stream", f"""WITH {SQL_KEPT}, g AS (SELECT stream_id, seq, slot, lag(slot) OVER w AS a, lag(seq) OVER w AS prev FROM kept WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
e AS (SELECT *, unnest(range(coalesce(a + 1, slot), slot + 1)) AS sl FROM g)
SELECT stream_id, sl AS slot, CASE WHEN slot - 1 - a >= 3 AND sl <= slot - 2 THEN prev ELSE seq END AS source_seq, sl <> slot AS filled, sl * 10000000 // 60 AS pts FROM e""")
def _(spark, sf):
    from clipgrove.operators.packets import slot_select

    kept = slot_select(packets(spark, sf).where("track = 'v'"), HOUR).select("stream_id", "seq", "slot")
    return run_steps(stepped(kept, "seq"), "step", STEPS, lambda df: R.fill_stream(df, 60), "fill")


# Streams of odd number lie twelve days back, so they fall silent while the others go on.
BACK_US = 12 * 24 * 3_600_000_000
SQL_CLOCK = f"1704067200000000 + time // 10 - stream_id % 2 * {BACK_US}"


def clocked(df: DataFrame) -> DataFrame:
    """Adds the event time ``ts`` and ``step``: thirds of all event time."""
    us = F.expr(f"1704067200000000 + time div 10 - stream_id % 2 * {BACK_US}")
    low, high = df.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    return df.withColumn("ts", F.timestamp_micros(us)).withColumn("step", part.cast("int"))


@query("r4_stall_fill_by_time", f"""WITH {SQL_KEPT}, k AS (SELECT kept.stream_id, kept.seq, slot, {SQL_CLOCK.replace("time", "fx_packets.time").replace("stream_id", "kept.stream_id")} AS us
  FROM kept JOIN fx_packets USING (seq)),
g AS (SELECT stream_id, seq, slot, lag(slot) OVER w AS a, lag(seq) OVER w AS prev FROM k WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
e AS (SELECT *, unnest(range(coalesce(a + 1, slot), slot + 1)) AS sl FROM g),
z AS (SELECT stream_id, max(seq) AS seq, max(slot) AS slot, max(slot) + ((SELECT max(us) // 1000 * 1000 FROM k) - max(us)) // {HOUR // 10} AS now FROM k GROUP BY 1),
t AS (SELECT *, unnest(range(slot + 1, now - 1)) AS sl FROM z WHERE now - 1 - slot >= 3)
SELECT stream_id, sl AS slot, CASE WHEN slot - 1 - a >= 3 AND sl <= slot - 2 THEN prev ELSE seq END AS source_seq, sl <> slot AS filled, sl * 10000000 // 60 AS pts FROM e
UNION ALL SELECT stream_id, sl, seq, true, sl * 10000000 // 60 FROM t""")
def _(spark, sf):
    """Three arrival steps; in the last ones the odd streams have no row, and their stall is filled by the clock of the others."""
    from clipgrove.operators.packets import slot_select

    kept = clocked(slot_select(packets(spark, sf).where("track = 'v'"), HOUR)).select("stream_id", "seq", "slot", "ts", "step")
    return run_steps(kept, "step", 3, lambda df: R.fill_stream(df, 60, clock="ts", interval_us=HOUR // 10), "fill")


@query("r5_away_changes", f"""WITH p AS (SELECT stream_id, {SQL_CLOCK} AS us, track = 'a' AS active FROM fx_packets),
m AS (SELECT stream_id, us FROM p WHERE active UNION SELECT stream_id, min(us) FROM p GROUP BY 1),
n AS (SELECT stream_id, us, lead(us) OVER (PARTITION BY stream_id ORDER BY us) AS nxt, (SELECT max(us) // 1000 * 1000 FROM p) AS now FROM m),
l AS (SELECT *, us + {2 * HOUR // 10} AS due FROM n WHERE nxt > us + {2 * HOUR // 10} OR (nxt IS NULL AND now >= us + {2 * HOUR // 10}))
SELECT stream_id, due AS at, true AS away FROM l UNION ALL SELECT stream_id, nxt, false FROM l WHERE nxt IS NOT NULL""")
def _(spark, sf):
    p = clocked(packets(spark, sf).select("stream_id", "time", F.expr("track = 'a' AS active")))
    return run_steps(p.drop("time"), "step", 3, lambda df: R.away_changes_stream(df, 2 * HOUR // 10), "away")


@query("w16_away_changes", f"""WITH p AS (SELECT stream_id, time, track = 'a' AS active FROM fx_packets),
m AS (SELECT stream_id, time FROM p WHERE active UNION SELECT stream_id, min(time) FROM p GROUP BY 1),
n AS (SELECT stream_id, time, lead(time) OVER (PARTITION BY stream_id ORDER BY time) AS nxt, max(time) OVER () AS now FROM m),
l AS (SELECT *, time + {2 * HOUR} AS due FROM n WHERE nxt > time + {2 * HOUR} OR (nxt IS NULL AND (SELECT max(time) FROM p) >= time + {2 * HOUR}))
SELECT stream_id, due AS at, true AS away FROM l UNION ALL SELECT stream_id, nxt, false FROM l WHERE nxt IS NOT NULL""")
def _(spark, sf):
    from clipgrove.operators.packets import away_changes

    p = packets(spark, sf).select("stream_id", "time", F.expr("track = 'a' AS active"))
    top = p.agg(F.max("time")).first()[0] or 0
    return away_changes(p, p.select("stream_id").distinct().withColumn("now", F.lit(top)), 2 * HOUR)


@query("r5_change_stream", "SELECT stream_id, seq, track FROM fx_packets QUALIFY lag(track) OVER (PARTITION BY stream_id ORDER BY seq) IS DISTINCT FROM track")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", "track")
    return run_steps(stepped(p, "seq"), "step", STEPS, lambda df: R.change_stream(df, "track"), "changes")


@query("r5_throttle_stream", """WITH RECURSIVE s AS (SELECT stream_id, seq, time, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, seq, r, time AS last, true AS ok FROM s WHERE r = 1
  UNION ALL SELECT s.stream_id, s.seq, s.r, CASE WHEN s.time - f.last >= 50000000000 THEN s.time ELSE f.last END, s.time - f.last >= 50000000000 FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1)
SELECT stream_id, seq FROM f WHERE ok""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", "time")
    return run_steps(stepped(p, "seq"), "step", STEPS, lambda df: R.throttle_stream(df, 50000000000), "throttle").select("stream_id", "seq")


@query("r5_rate_limit_stream", """WITH RECURSIVE s AS (SELECT stream_id, seq, time, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM fx_packets),
f AS (SELECT stream_id, seq, r, time AS opened, 1 AS sent FROM s WHERE r = 1
  UNION ALL SELECT s.stream_id, s.seq, s.r, CASE WHEN s.time - f.opened > 400000000000 THEN s.time ELSE f.opened END, CASE WHEN s.time - f.opened > 400000000000 THEN 1 ELSE f.sent + 1 END
  FROM f JOIN s ON s.stream_id = f.stream_id AND s.r = f.r + 1)
SELECT stream_id, seq FROM f WHERE sent <= 5""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", "time")
    return run_steps(stepped(p, "seq"), "step", STEPS, lambda df: R.rate_limit_stream(df, 400000000000, 5), "rate").select("stream_id", "seq")


@query("r5_away_stream", f"""WITH a AS (SELECT stream_id, seq, time, track = 'a' AS active FROM fx_packets)
SELECT stream_id, seq, NOT active AND time - coalesce(max(CASE WHEN active THEN time END) OVER w, min(time) OVER w) >= {2 * HOUR} AS away FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", "time", F.expr("track = 'a' AS active"))
    return run_steps(stepped(p, "seq"), "step", STEPS, lambda df: R.away_stream(df, 2 * HOUR), "away").select("stream_id", "seq", "away")


@query("r6_header_handshake", """WITH b AS (SELECT stream_id, min(time) AS base FROM fx_packets WHERE track = 'v' AND key GROUP BY 1)
SELECT p.stream_id, p.seq, p.track, p.time - base AS out_time FROM fx_packets p JOIN b ON p.stream_id = b.stream_id WHERE p.time >= base""")
def _(spark, sf):
    """The video header comes first, the audio header with the second arrival step."""
    p = packets(spark, sf).select("stream_id", "seq", "track", "time", "key", F.lit(False).alias("header"))
    p = stepped(p, "seq")
    first = p.groupBy("stream_id").agg(F.lit(-2).cast("bigint").alias("seq"))
    v = first.select("stream_id", "seq", F.lit("v").alias("track"), F.lit(0).cast("bigint").alias("time"), F.lit(False).alias("key"), F.lit(True).alias("header"), F.lit(0).alias("step"))
    a = v.withColumn("track", F.lit("a")).withColumn("seq", F.lit(-1).cast("bigint")).withColumn("step", F.lit(1))
    return run_steps(p.unionByName(v).unionByName(a), "step", STEPS, lambda df: R.handshake_stream(df, ["v", "a"], None), "headers")


@query("r7_continuity_stream", f"WITH {SQL_CONT}")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "segment", "track", "seq", "seg_time", "dur", "key")
    return run_steps(stepped(p, "seq"), "step", STEPS, R.continuity_stream, "continuity").select("stream_id", "seq", "out_time")


@query("r8_upsert_stream", """WITH RECURSIVE b AS (SELECT user_id AS name, event_id AS seq, epoch_us(ts) // 1000000 AS sec FROM events),
s AS (SELECT name, sec, seq, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM b), f AS (SELECT name, r, sec AS last, seq FROM s WHERE r = 1
  UNION ALL SELECT s.name, s.r, CASE WHEN s.sec - f.last >= 86400 THEN s.sec ELSE f.last END, CASE WHEN s.sec - f.last >= 86400 THEN s.seq ELSE f.seq END FROM f JOIN s ON s.name = f.name AND s.r = f.r + 1)
SELECT cast(name AS string) AS name, arg_max(seq, r) AS appid, max(last) AS last_seen FROM f GROUP BY name""")
def _(spark, sf):
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000000"
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("appid"), F.expr(f"{us} AS at"), F.col("event_id").alias("seq"))
    path = run_sink(stepped(e, "seq"), "step", STEPS, lambda df, out, state: R.seen_stream(df, out, state, 86400), "seen")
    return R.seen_table(spark, path)


@query("r9_coalesce_bursts", """WITH s AS (SELECT stream_id, seq, track, seq >= (SELECT CASE WHEN (max(seq) + 1) // 5000 > 0 THEN (max(seq) + 1) // 5000 * 2500 ELSE (max(seq) + 1) // 2 END FROM fx_packets) AS later FROM fx_packets)
SELECT stream_id, max(seq) AS seq, arg_max(track, seq) AS track FROM s GROUP BY stream_id, later""")
def _(spark, sf):
    p = packets(spark, sf).select("stream_id", "seq", "track")
    path = run_sink(stepped(p, "seq"), "step", STEPS, R.coalesce_bursts, "bursts")
    return spark.read.parquet(path).select("stream_id", "seq", "track")


@query("r10_log_stream", """WITH o AS (SELECT *, substr(line, 1, 10) AS day FROM fx_logs WHERE target IN ('app', 'ui') OR starts_with(target, 'app::')),
r AS (SELECT day, n, line, sum(strlen(line) + 1) OVER (PARTITION BY day ORDER BY n) AS b FROM o)
SELECT n, line, false AS notice FROM r WHERE b <= 6000
UNION ALL SELECT min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 6000 bytes reached'), true FROM r WHERE b > 6000 GROUP BY day""")
def _(spark, sf):
    lines = view(spark, sf, "fx_logs")
    return run_steps(stepped(lines, "n"), "step", STEPS, lambda df: R.log_stream(df, "app", 6000), "logs").select("n", "line", "notice")


SQL_PARTS = """s AS (SELECT stream_id, segment, arg_min(width, seq) AS width, coalesce(string_agg(DISTINCT CASE WHEN track <> 'v' THEN track END, ','), '') AS layout FROM fx_packets GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(width) OVER w <> width OR lag(layout) OVER w <> layout THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY segment)),
p AS (SELECT stream_id, segment, cast(sum(ch) OVER (PARTITION BY stream_id ORDER BY segment) AS bigint) AS part FROM c),
r AS (SELECT f.*, part FROM fx_packets f JOIN p ON p.stream_id = f.stream_id AND p.segment = f.segment), k AS (SELECT stream_id, part, min(seq) AS k FROM r WHERE track = 'v' AND key GROUP BY 1, 2)"""


@query("s11_recording_parts", f"WITH {SQL_PARTS} SELECT r.stream_id, r.part, r.seq, r.track FROM r JOIN k ON r.stream_id = k.stream_id AND r.part = k.part WHERE seq >= k.k")
def _(spark, sf):
    from clipgrove.streaming.drive import scratch

    path = scratch(spark, "parts")
    R.write_parts(packets(spark, sf), path)
    return spark.read.parquet(path).select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("part").cast("bigint").alias("part"), "seq", "track")


@query("s11_recording_sink", f"WITH {SQL_PARTS} SELECT r.stream_id, r.part, r.seq, r.track FROM r JOIN k ON r.stream_id = k.stream_id AND r.part = k.part WHERE seq >= k.k")
def _(spark, sf):
    """The stream in three micro-batches, each cut inside a segment and between keyframes."""
    p = packets(spark, sf)
    top = p.groupBy("stream_id").agg(F.max("seq").alias("_top"))
    step = F.when(F.col("seq") < F.col("_top") * 0.31, 0).when(F.col("seq") < F.col("_top") * 0.67, 1).otherwise(2)
    rows = p.join(top, "stream_id").withColumn("step", step).drop("_top")
    path = run_sink(rows, "step", 3, R.recording_sink, "sink")
    return spark.read.parquet(path).select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("part").cast("bigint").alias("part"), "seq", "track")


@query("s10_daily_log_sink", """WITH d AS (SELECT DISTINCT substr(line, 1, 10) AS day FROM fx_logs ORDER BY day DESC LIMIT 7),
r AS (SELECT substr(line, 1, 10) AS day, n, line, sum(strlen(line) + 1) OVER (PARTITION BY substr(line, 1, 10) ORDER BY n) AS b FROM fx_logs WHERE substr(line, 1, 10) IN (SELECT day FROM d))
SELECT n, line FROM r WHERE b <= 9000 UNION ALL SELECT min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 9000 bytes reached') FROM r WHERE b > 9000 GROUP BY day""")
def _(spark, sf):
    from clipgrove.sources.logs import read_daily, write_daily
    from clipgrove.streaming.drive import scratch

    path = scratch(spark, "daily")
    logs = view(spark, sf, "fx_logs")
    # two calls, most days in both
    middle = logs.groupBy(F.substring("line", 1, 10).alias("_day")).agg(((F.min("n") + F.max("n")) / 2).alias("_mid"))
    parts = logs.withColumn("_day", F.substring("line", 1, 10)).join(middle, "_day")
    for half in (F.col("n") <= F.col("_mid"), F.col("n") > F.col("_mid")):
        write_daily(parts.where(half).select(*logs.columns), path, 9000)
    return read_daily(spark, path).select("n", "line")


MACHINE = "n % 3"
SQL_FLEET = f"""l AS (SELECT cast({MACHINE} AS bigint) AS machine, substr(line, 1, 10) AS day, n, line, strlen(line) + 1 AS b FROM fx_logs),
d AS (SELECT machine, day FROM (SELECT DISTINCT machine, day FROM l) QUALIFY row_number() OVER (PARTITION BY machine ORDER BY day DESC) <= 7)"""


def fleet(spark, sf):
    return view(spark, sf, "fx_logs").select(F.expr(f"cast({MACHINE} AS bigint)").alias("machine"), "n", "target", "line")


@query("s10_daily_logs_of_machines", f"""WITH {SQL_FLEET}, r AS (SELECT l.*, sum(b) OVER (PARTITION BY l.machine, l.day ORDER BY n) AS t FROM l JOIN d ON d.machine = l.machine AND d.day = l.day)
SELECT machine, day, n, line, false AS notice FROM r WHERE t <= 3000
UNION ALL SELECT machine, day, min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 3000 bytes reached'), true FROM r WHERE t > 3000 GROUP BY 1, 2""")
def _(spark, sf):
    """Every machine has its own budget and its own seven days; every batch is delivered twice."""
    from clipgrove.sources.logs import read_daily, write_daily
    from clipgrove.streaming.drive import scratch

    path, logs = scratch(spark, "fleet"), fleet(spark, sf)
    middle = logs.groupBy("machine", F.substring("line", 1, 10).alias("_day")).agg(((F.min("n") + F.max("n")) / 2).alias("_mid"))
    parts = logs.withColumn("_day", F.substring("line", 1, 10)).join(middle, ["machine", "_day"])
    for number, half in enumerate((F.col("n") <= F.col("_mid"), F.col("n") > F.col("_mid"))):
        for _ in range(2):
            write_daily(parts.where(half).select("machine", "n", "line"), path, 3000, machine="machine", batch=number)
    return read_daily(spark, path).select("machine", "day", "n", "line", "notice")


@query("w11_w12_logs_of_machines", f"""WITH {SQL_FLEET}, r AS (SELECT l.*, sum(b) OVER (PARTITION BY l.machine, l.day ORDER BY n) AS t FROM l JOIN d ON d.machine = l.machine AND d.day = l.day)
SELECT machine, day, n, line, false AS notice FROM r WHERE t <= 2000
UNION ALL SELECT machine, day, min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 2000 bytes reached'), true FROM r WHERE t > 2000 GROUP BY 1, 2""")
def _(spark, sf):
    from clipgrove.sources.logs import byte_budget, keep_last

    logs = fleet(spark, sf).withColumn("day", F.substring("line", 1, 10)).drop("target")
    last = keep_last(logs.select("machine", F.col("day").alias("name")).distinct(), 7, ".*", keys=("machine",)).withColumnRenamed("name", "day")
    return byte_budget(logs.join(last, ["machine", "day"], "left_semi"), 2000, keys=("machine", "day"))


@query("r10_logs_of_machines", f"""WITH o AS (SELECT cast({MACHINE} AS bigint) AS machine, *, substr(line, 1, 10) AS day FROM fx_logs WHERE target IN ('app', 'ui') OR starts_with(target, 'app::')),
r AS (SELECT machine, day, n, line, sum(strlen(line) + 1) OVER (PARTITION BY machine, day ORDER BY n) AS b FROM o)
SELECT machine, n, line, false AS notice FROM r WHERE b <= 2000
UNION ALL SELECT machine, min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 2000 bytes reached'), true FROM r WHERE b > 2000 GROUP BY machine, day""")
def _(spark, sf):
    return run_steps(stepped(fleet(spark, sf), "n"), "step", STEPS, lambda df: R.log_stream(df, "app", 2000, "machine"), "fleet").select("machine", "n", "line", "notice")
