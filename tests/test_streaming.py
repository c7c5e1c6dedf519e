import time

from conftest import rows
from pyspark.sql import functions as F

from clipgrove.streaming import operators as R
from clipgrove.streaming.drive import run_steps


def test_handshake_timeout(spark, frame, tmp_path):
    """A track that never sends a header is dropped once the time is up."""
    schema = "stream_id bigint, seq bigint, track string, time bigint, key boolean, header boolean"
    data = [(1, 0, "v", 0, False, True), (1, 1, "v", 5, False, False), (1, 2, "a", 6, False, False), (1, 3, "v", 10, True, False), (1, 4, "v", 15, False, False)]
    src = str(tmp_path / "in")
    frame(schema, data).coalesce(1).write.parquet(src)
    df = spark.readStream.schema(schema).parquet(src)
    out = R.handshake_stream(df, ["v", "a"], 500)
    q = out.writeStream.format("memory").queryName("handshake").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("handshake").count() < 2:
            time.sleep(1)
        assert rows(spark.table("handshake"), "seq", "track", "out_time") == [(3, "v", 0), (4, "v", 5)]
    finally:
        q.stop()


def test_mix_drops_only_late_frames(spark, frame):
    """A packet that comes after its stream's clock has passed loses the frames already written."""
    schema = "stream_id bigint, source bigint, frame bigint, ch int, sample int, step int"
    first = [(1, 0, f, 0, 100, 0) for f in range(0, 48_000, 480)]
    late = [(1, 1, f, 0, 11, 1) for f in range(38_400, 48_000, 480)]
    end = [(1, 0, 96_000, 0, 1, 2)]
    out = run_steps(frame(schema, first + late + end), "step", 3, R.mix_stream, "late")
    got = {r.frame: r.sample for r in out.collect()}
    # The first step ends with frame 47520, so frames 150 ms before it are written before the second.
    written = 47_520 - 150 * 48
    assert got == {f: 111 if f > written else 100 for f in range(0, 48_000, 480)}


def test_latest_per_key(frame):
    df = frame("stream_id bigint, seq bigint, state string", [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    assert rows(R.latest_per_key(df), "stream_id", "state") == [(1, "b"), (2, "c")]


START = 1000  # a row at the epoch itself would be behind the first watermark


def timed(frame, data):
    schema = "stream_id bigint, seq bigint, slot bigint, active boolean, sec double, step int"
    return frame(schema, data).withColumn("ts", F.timestamp_micros(((F.col("sec") + START) * 1_000_000).cast("bigint"))).drop("sec")


def test_stall_is_filled_by_the_clock_of_other_streams(frame):
    """Stream 1 stops after slot 2. In the second step only stream 2 goes on; in the third stream 1 is back at slot 20."""
    one = [(1, 0, 0, True, 0.0, 0), (1, 1, 2, True, 2.0, 0)]
    two = [(2, 10 + k, k, True, float(k), 0 if k <= 2 else 1) for k in range(12)]
    back = [(1, 2, 20, True, 20.0, 2)]
    fill = lambda df: R.fill_stream(df, 60, clock="ts", interval_us=1_000_000)
    slots = lambda out: rows(out.where("stream_id = 1"), "slot", "source_seq", "filled")
    silent = run_steps(timed(frame, one + two), "step", 2, fill, "silent")
    want = [(0, 0, False), (1, 1, True), (2, 1, False), *[(k, 1, True) for k in range(3, 10)]]
    assert slots(silent) == want  # the watermark is at slot 11: 10 and 11 belong to the next row
    whole = run_steps(timed(frame, one + two + back), "step", 3, fill, "back")
    assert slots(whole) == want + [(k, 1, True) for k in range(10, 19)] + [(19, 2, True), (20, 2, False)]


def test_away_when_nothing_arrives(frame):
    data = [(1, 0, 0, True, 0.0, 0), (1, 1, 0, False, 30.0, 0), (2, 2, 0, True, 50.0, 0), (2, 3, 0, True, 100.0, 1), (2, 4, 0, True, 130.0, 2), (1, 5, 0, True, 200.0, 3),
            (1, 6, 0, True, 259.0, 3), (2, 7, 0, True, 400.0, 4)]
    changes = lambda n: rows(run_steps(timed(frame, [d for d in data if d[-1] < n]).drop("slot"), "step", n, R.away_changes_stream, "away"))
    s = 1_000_000
    assert changes(1) == []
    at = lambda *r: [(k, (START + t) * s, a) for k, t, a in r]
    assert changes(2) == at((1, 60, True))
    assert changes(5) == at((1, 60, True), (1, 200, False), (1, 319, True), (2, 190, True), (2, 400, False))
