"""Streaming forms of the packet, log and upsert operators. Inputs are streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clipgrove.functions import timebase as B
from clipgrove.operators.packets import AWAY_AFTER, STALL_SLOTS, split_parts
from clipgrove.operators.scan import first_per_key
from clipgrove.operators.stateful import upsert_seen
from clipgrove.session import STATE_STORE
from clipgrove.sources.logs import MAX_DAY_BYTES, own_logs, parse_line
from clipgrove.sources.versions import KeyedTable
from clipgrove.streaming import processors as S

# Fixed values.
MIX_LATENESS = {"mix": 150_000, "single": 120_000, "app": 100_000}
MAX_AHEAD_FRAMES = 5 * B.SAMPLE_RATE
HEADER_TIMEOUT_MS = 1000


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _keyed(df: DataFrame, keys: list[str], processor, schema, time_mode: str = "None") -> DataFrame:
    prepare(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def _plus(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields.items()]])


def slot_stream(df: DataFrame, interval: int, keys: list[str] = ["stream_id"]) -> DataFrame:
    return _keyed(df, keys, S.SlotSelect(interval), _plus(df, slot=T.LongType()))


def fill_stream(kept: DataFrame, fps: int, stall: int = STALL_SLOTS, clock: str | None = None, interval_us: int = 0, lateness: str = "0 seconds") -> DataFrame:
    """kept(stream_id, seq, slot[, <clock>]): gap filling as rows arrive. With ``clock``, a timestamp column, and the length of a slot
    a stall is filled while nothing arrives, as far as the watermark of all streams (``lateness`` behind the newest row) has
    come; the rows are the same, and those of a stall that has no end yet besides."""
    schema = "stream_id bigint, slot bigint, source_seq bigint, filled boolean, pts bigint"
    if clock:
        rows = kept.withWatermark(clock, lateness).select("stream_id", "seq", "slot", clock, F.unix_micros(clock).alias("us"))
        return _keyed(rows, ["stream_id"], S.TimedGapFill(stall, fps, interval_us), schema, "EventTime")
    return _keyed(kept.select("stream_id", "seq", "slot"), ["stream_id"], S.GapFill(stall, fps), schema)


def change_stream(df: DataFrame, column: str, keys: list[str] = ["stream_id"]) -> DataFrame:
    return _keyed(df, keys, S.Changes(column), df.schema)


def throttle_stream(df: DataFrame, gap: int, keys: list[str] = ["stream_id"]) -> DataFrame:
    return _keyed(df, keys, S.Throttle(gap), df.schema)


def rate_limit_stream(df: DataFrame, window: int, most: int, keys: list[str] = ["stream_id"]) -> DataFrame:
    return _keyed(df, keys, S.RateLimit(window, most), df.schema)


def away_stream(df: DataFrame, gap: int = AWAY_AFTER, keys: list[str] = ["stream_id"]) -> DataFrame:
    return _keyed(df, keys, S.Away(gap), _plus(df, away=T.BooleanType()))


def away_changes_stream(df: DataFrame, gap_us: int = AWAY_AFTER // 10, clock: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """df(stream_id, active, <clock>) -> (stream_id, at in microseconds, away): a row when a stream has been without activity for ``gap_us``, written
    when event time passes though nothing arrives for it, and one when it is back."""
    rows = df.withWatermark(clock, lateness).select("stream_id", "active", clock, F.unix_micros(clock).alias("us"))
    return _keyed(rows, ["stream_id"], S.TimedAway(gap_us), "stream_id bigint, at bigint, away boolean", "EventTime")


def continuity_stream(df: DataFrame) -> DataFrame:
    """df(stream_id, segment, track, seq, seg_time, dur, key)."""
    return _keyed(df, ["stream_id"], S.Continuity(), "stream_id bigint, seq bigint, out_time bigint")


def ring_stream(packets: DataFrame, requests: DataFrame, window: int) -> DataFrame:
    """Snapshots for requests(request_id, stream_id, at) out of a bounded state."""
    p = packets.select("stream_id", F.lit(0).alias("kind"), "segment", "track", "seq", "time", "key")
    none = F.lit(None)
    r = requests.select(
        "stream_id", F.lit(1).alias("kind"), none.cast("bigint").alias("segment"), none.cast("string").alias("track"),
        F.col("request_id").alias("seq"), F.col("at").alias("time"), none.cast("boolean").alias("key"))
    schema = "stream_id bigint, request_id bigint, seq bigint, track string, out_time bigint"
    return _keyed(p.unionByName(r), ["stream_id"], S.Ring(window), schema)


def handshake_stream(df: DataFrame, expected: list[str], timeout_ms: int | None = HEADER_TIMEOUT_MS) -> DataFrame:
    """df(stream_id, seq, track, time, key, header): ``header`` rows announce a track. The timeout
    runs on processing time and is for continuous triggers: such a query always has a next batch,
    so a run over what is there (``availableNow``) takes None and waits for headers only."""
    schema = "stream_id bigint, seq bigint, track string, out_time bigint"
    mode = "None" if timeout_ms is None else "ProcessingTime"
    return _keyed(df, ["stream_id"], S.Handshake(expected, timeout_ms), schema, mode)


def log_stream(lines: DataFrame, crate: str, cap: int = MAX_DAY_BYTES, machine: str | None = None) -> DataFrame:
    """lines(n, target, line[, <machine>]): own targets, split into fields, within the budget of each day, which each machine has for itself."""
    keys = [machine] if machine else []
    own = own_logs(lines, crate).select(*keys, F.substring("line", 1, 10).alias("day"), "n", "line")
    kept = _keyed(own, [*keys, "day"], S.DayBudget(cap), _plus(own, notice=T.BooleanType()))
    return kept.select(*keys, "n", "line", "notice", *parse_line(F.col("line")))


def mix_stream(samples: DataFrame, lateness: int = MIX_LATENESS["mix"], rate: int = B.SAMPLE_RATE) -> DataFrame:
    """samples(stream_id, source, frame, ch, sample [, now_frame]): sums per frame once the stream itself is ``lateness`` microseconds
    past it, so streams that start later or run slower lose nothing. One row is one frame, so of a late packet exactly the
    frames still open count; a row without a sample ends its stream. With ``now_frame`` samples too far ahead of it are discarded."""
    rows = samples
    if "now_frame" in samples.columns:
        rows = rows.where(F.coalesce(F.col("frame") - F.col("now_frame") <= MAX_AHEAD_FRAMES, F.lit(True)))
    return _keyed(rows.select("stream_id", "frame", "ch", "sample"), ["stream_id"], S.Mix(lateness, rate), "stream_id bigint, frame bigint, ch int, sample int")


# --- per micro-batch -------------------------------------------------------------------

def latest_per_key(batch: DataFrame, keys: list[str] = ["stream_id"], order: str = "seq") -> DataFrame:
    """A burst counts once: the last row of each key in a micro-batch."""
    return first_per_key(batch, [F.col(k) for k in keys], [F.col(order)], last=True)


def coalesce_bursts(df: DataFrame, path: str, checkpoint: str, keys: list[str] = ["stream_id"], order: str = "seq"):
    def write(batch: DataFrame, epoch: int) -> None:
        latest_per_key(batch, keys, order).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


SEEN = "name string, appid bigint, last_seen bigint"


def seen_keyed(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, SEEN, ["name"])


def seen_table(spark: SparkSession, path: str) -> DataFrame:
    """The table kept by ``seen_stream``, after its last finished micro-batch."""
    return seen_keyed(spark, path).read()


def seen_stream(df: DataFrame, path: str, checkpoint: str, gap: int = 60):
    """df(name, appid, at, seq): keyed upserts. A micro-batch rewrites the buckets of its names; one that is repeated after a
    failure changes nothing more."""

    def write(batch: DataFrame, epoch: int) -> None:
        seen_keyed(batch.sparkSession, path).merge(epoch, batch.select("name", "appid", "at", "seq"), lambda old, new: upsert_seen(old, new, gap))

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --- recordings ------------------------------------------------------------------------

def part_rows(packets: DataFrame) -> DataFrame:
    """Packets with their recording part; each part starts on its first video keyframe, parts
    without one are not written."""
    parted = packets.join(split_parts(packets).select("stream_id", "segment", "part"), ["stream_id", "segment"])
    first = parted.where("track = 'v' AND key").groupBy("stream_id", "part").agg(F.min("seq").alias("_k"))
    return parted.join(first, ["stream_id", "part"]).where(F.col("seq") >= F.col("_k")).drop("_k")


def write_parts(packets: DataFrame, path: str) -> None:
    """One folder per recording and part."""
    part_rows(packets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "part").parquet(path)


OPEN = "stream_id bigint, segment bigint, width bigint, layout string, part bigint, open boolean"


def _last_state(spark: SparkSession, path: str, before: int) -> DataFrame:
    """State after the newest finished micro-batch before ``before``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and int(n[2:]) < before and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
    for v in sorted(done)[:-2]:  # two versions are enough for a batch that is repeated
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"v={v}"), True)
    return spark.read.schema(OPEN).parquet(f"{path}/v={max(done)}") if done else spark.createDataFrame([], OPEN)


def continued_parts(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets of ``batch`` with their part, new state). ``state`` holds one row per stream: its last segment with its shape, the part and whether
    a keyframe has opened that part. A segment that goes on keeps part and shape; numbers go on from the state."""
    last = state.select("stream_id", F.col("segment").alias("_s"), F.col("width").alias("_w"), F.col("layout").alias("_l"), F.col("part").alias("_p"), F.col("open").alias("_o"))
    shape = split_parts(batch).select("stream_id", "segment", "width", "layout", F.col("part").alias("_own"))
    shape = shape.join(last, "stream_id", "left").withColumn("_same", F.coalesce(F.col("segment") == F.col("_s"), F.lit(False)))
    # split_parts numbers this batch alone, by its own shapes; what its first new segment adds is seen against the state
    fresh = shape.where(~F.col("_same")).groupBy("stream_id").agg(F.min_by(F.struct("width", "layout", "_own"), "segment").alias("_first"))
    shape = shape.join(fresh, "stream_id", "left")
    differs = F.col("_s").isNotNull() & ((F.col("_first.width") != F.col("_w")) | (F.col("_first.layout") != F.col("_l")))
    part = F.when(F.col("_same"), F.col("_p")).otherwise(F.coalesce("_p", F.lit(0)) + differs.cast("bigint") + F.col("_own") - F.col("_first._own"))
    known = shape.select("stream_id", "segment", F.when(F.col("_same"), F.col("_w")).otherwise(F.col("width")).cast("bigint").alias("_width"),
                         F.when(F.col("_same"), F.col("_l")).otherwise(F.col("layout")).alias("_layout"), part.alias("part"), "_p", "_o")
    rows = batch.join(known, ["stream_id", "segment"])
    goes_on = F.coalesce((F.col("part") == F.col("_p")) & F.col("_o"), F.lit(False))
    opened = rows.groupBy("stream_id", "part").agg(F.min(F.when((F.col("track") == "v") & F.col("key"), F.col("seq"))).alias("_k"), F.max(goes_on).alias("_on"))
    rows = rows.join(opened, ["stream_id", "part"])
    ends = known.groupBy("stream_id").agg(F.max_by(F.struct("segment", "_width", "_layout", "part"), "segment").alias("e")).select("stream_id", "e.*")
    ends = ends.join(opened, ["stream_id", "part"]).select("stream_id", "segment", F.col("_width").alias("width"), F.col("_layout").alias("layout"), "part", (F.col("_on") | F.col("_k").isNotNull()).alias("open"))
    kept = state.join(ends.select("stream_id"), "stream_id", "left_anti").select(*ends.columns)
    out = rows.where(F.col("_on") | (F.col("seq") >= F.col("_k"))).select(*batch.columns, "part")
    return out, ends.unionByName(kept)


def recording_sink(df: DataFrame, path: str, checkpoint: str):
    """Stream of packets to parts, one folder per recording, micro-batch and part. Part numbers, the current shape and an open part outlast
    the micro-batch, wherever it is cut; a batch that is repeated after a failure overwrites its own files and state."""

    def write(batch: DataFrame, epoch: int) -> None:
        state = _last_state(batch.sparkSession, f"{checkpoint}-parts", epoch)
        out, new = continued_parts(batch, state)
        out.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "epoch", "part").parquet(path)
        new.write.mode("overwrite").parquet(f"{checkpoint}-parts/v={epoch}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
