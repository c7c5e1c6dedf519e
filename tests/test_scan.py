"""Running values, time joins and recurrences against plain loops, with chunks of a few rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clipgrove.operators import packets as P, samples as M, stateful as S
from clipgrove.operators.ranges import expand
from clipgrove.operators.scan import Run, first_per_key, neighbours, repack, rows_chunk, running, span_chunk
from clipgrove.operators.timejoin import asof, interval_join


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_running(frame, size, reverse):
    rng = random.Random(size)
    data = [(rng.randrange(3), i, rng.randrange(-9, 9), rng.randrange(9) if rng.random() < 0.4 else None) for i in range(60)]
    df = frame("k bigint, i bigint, x bigint, y bigint", data)
    outs = {}
    for inc in (True, False):
        for kind in ("sum", "max", "min"):
            outs[f"{kind}{inc}"] = Run(kind, F.col("x"), inc, reverse)
        outs[f"last{inc}"] = Run("last", F.col("y"), inc, reverse)
    got = {(r.k, r.i): r for r in running(df, ["k"], ["i"], outs, rows_chunk("i", size)).collect()}
    assert len(got) == len(data)
    for k, i, _, _ in data:
        for inc in (True, False):
            before = [r for r in data if r[0] == k and ((r[1] >= i) if reverse else (r[1] <= i)) and (inc or r[1] != i)]
            before.sort(key=lambda r: -r[1] if reverse else r[1])
            xs = [r[2] for r in before]
            ys = [r[3] for r in before if r[3] is not None]
            row = got[(k, i)]
            assert row[f"sum{inc}"] == (sum(xs) if xs else None)
            assert row[f"max{inc}"] == (max(xs) if xs else None)
            assert row[f"min{inc}"] == (min(xs) if xs else None)
            assert row[f"last{inc}"] == (ys[-1] if ys else None)


def test_neighbours_keep_nulls(frame):
    df = frame("k bigint, i bigint, v string", [(0, 0, "a"), (0, 5, None), (0, 9, "c"), (1, 2, "z")])
    out = neighbours(df, ["k"], ["i"], rows_chunk("i", 2), {"p": F.col("v")}, {"n": F.col("v")})
    assert rows(out, "k", "i", "p", "n") == [(0, 0, None, None), (0, 5, "a", "c"), (0, 9, None, None), (1, 2, None, None)]
    assert rows(repack(df, ["k"], ["i"], rows_chunk("i", 2), "at"), "i", "at") == [(0, 0), (2, 0), (5, 1), (9, 2)]
    assert rows(first_per_key(df, [F.col("k")], [F.col("i")], last=True), "v") == [("c",), ("z",)]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_time_joins(frame, width):
    rng = random.Random(width)
    right = [(rng.randrange(2), rng.randrange(60), n) for n in range(40)]
    left = [(rng.randrange(3), rng.randrange(70), q) for q in range(50)]
    l, r = frame("k bigint, t bigint, q bigint", left), frame("k bigint, u bigint, n bigint", right)
    both = asof(l, r, ["k"], "t", "u", width, {"m": "n"}, {"a": "n"}, tie=["n"]).collect()
    back, ahead = {x.q: x.m for x in both}, {x.q: x.a for x in both}
    for k, t, q in left:
        low = [(u, n) for kk, u, n in right if kk == k and u <= t]
        high = [(u, n) for kk, u, n in right if kk == k and u > t]
        assert back[q] == (max(low)[1] if low else None)
        assert ahead[q] == (min(high)[1] if high else None)
    spans = frame("k bigint, a bigint, b bigint, s bigint", [(k, u, u + n % 15, n) for k, u, n in right])
    got = {(x.q, x.s) for x in interval_join(l, spans, ["k"], "t", F.col("a"), F.col("b"), width).collect()}
    assert got == {(q, n) for k, t, q in left for kk, u, n in right if kk == k and u <= t < u + n % 15}


def test_rows_of_a_span_stand_together(frame):
    points = [(i % 2, i // 8, i) for i in range(1600)]
    spans = [(s % 2, 5 * s, 5 * s + 90, s) for s in range(20)]
    hit = interval_join(frame("k bigint, t bigint, q bigint", points), frame("k bigint, a bigint, b bigint, s bigint", spans), ["k"], "t", F.col("a"), F.col("b"), 100)
    got = [(r.s, r.t, r.q) for r in hit.collect()]
    assert sorted(got) == sorted((s, t, q) for k, t, q in points for kk, a, b, s in spans if k == kk and a <= t < b)
    # Each span touches at most two buckets of 400 points, which are two blocks; behind a new span or block the time may fall.
    assert sum(x[0] != y[0] or x[1] > y[1] for x, y in zip(got, got[1:])) < 4 * len(spans)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_interval_join_of_odd_rows(frame, block):
    rng = random.Random(block)
    points = [(rng.choice([0, 1, None]), rng.choice([None, *range(-20, 20)]), rng.choice([None, "x"])) for _ in range(200)]
    spans = [(rng.choice([0, 1, None]), rng.choice([None, -9, 0, 4]), rng.choice([None, 0, 4, 12]), s) for s in range(30)]
    hit = interval_join(frame("k bigint, t bigint, v string", points), frame("k bigint, a bigint, b bigint, s bigint", spans), ["k"], "t", F.col("a"), F.col("b"), 6, block)
    want = [(k, t, v, s) for k, t, v in points for kk, a, b, s in spans if None not in (k, t, a, b) and k == kk and a <= t < b]
    assert rows(hit, "k", "t", "v", "s") == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_overlapping_recordings_are_small_when_written(frame, tmp_path):
    at = [(i % 100) ** 2 * 12_345 for i in range(4000)]
    p = stream(frame, [(0, 0, "v", i, t, t, 1, True, 1, 1) for i, t in enumerate(at)])
    req = frame("request_id bigint, stream_id bigint, at bigint, stop bigint", [(n, 0, at[n % 100], 10**10) for n in range(200)])
    out = P.record(req, p).select("request_id", "seq", "track", "out_time")
    out.coalesce(1).write.parquet(f"{tmp_path}/out")
    n = out.count()
    assert n == 2 * 40 * 100 * 101 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < n / 2


def test_overlapping_recordings_are_dealt_over_tasks(frame):
    p = stream(frame, [(0, 0, "v", i, i, i, 1, i == 0, 1, 1) for i in range(2000)])
    req = frame("request_id bigint, stream_id bigint, at bigint, stop bigint", [(n, 0, 10 * n, 2000) for n in range(50)])
    out = P.record(req, p, span=20, columns=["seq"]).groupBy(F.spark_partition_id().alias("task")).count()
    per = [r["count"] for r in out.collect()]
    # 100 buckets of equal size; both sides are small enough for one task.
    assert sum(per) == 100_000 and max(per) < 50_000


@pytest.mark.parametrize("seed", range(4))
def test_throttle_over_chunks(frame, seed):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 2, 5, 30, -3])
        data.append((i % 2, i, t))
    df = frame("k bigint, seq bigint, time bigint", data)
    got = {r.seq: r.accepted for r in S.accepted(df, ["k"], "time", "seq", 17, span_gaps=2).collect()}
    last = {}
    for k, i, t in data:
        ok = k not in last or t - last[k] >= 17
        assert got[i] == ok, i
        if ok:
            last[k] = t


def test_rate_limit(frame):
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(400):
        t += rng.choice([0, 1, 1, 4, 40])
        times.append(t)
    df = frame("k bigint, n bigint, ms bigint", [(0, i, t) for i, t in enumerate(times)])
    got = {r.n for r in S.rate_limit(df, ["k"], "ms", 60, 20, "n").collect()}
    opened, sent, want = None, 0, set()
    for i, t in enumerate(times):
        if opened is None or t - opened > 60:
            opened, sent = t, 0
        sent += 1
        if sent <= 20:
            want.add(i)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_clock_cursor_over_chunks(frame, seed):
    rng = random.Random(seed)
    data, clock = [], 0
    for i in range(240):
        frames = rng.choice([0, 480, 480, 441])
        data.append((i % 2, i, clock + rng.randrange(-120, 120), frames))
        clock += frames // 2 + (rng.choice([9000, -9000]) if rng.random() < 0.03 else 0)
    df = frame("source bigint, seq bigint, stamp bigint, frames bigint", data)
    got = {r.seq: (r.at, r.adjust) for r in M.place(df, ["source"], chunk_rows=11).collect()}
    expected = {}
    for k, i, stamp, frames in data:
        if frames == 0:
            assert i not in got
            continue
        p = expected.get(k)
        if p is None or abs(stamp - p) > 4800:
            want = (stamp, 0)
        else:
            want = (p, 1 if stamp - p > 48 else -1 if stamp - p < -48 else 0)
        assert got[i] == want
        expected[k] = want[0] + frames + want[1]


def test_placed_frames(frame):
    df = frame("source bigint, at bigint, adjust int, samples array<smallint>", [(0, 10, 1, [7, 8]), (1, 4, -1, [1, 2, 3]), (2, 0, 0, [5])])
    assert rows(M.placed_frames(df)) == [(0, 10, 7), (0, 11, 7), (0, 12, 8), (1, 4, 2), (1, 5, 3), (2, 0, 5)]


def stream(frame, data):
    return frame("stream_id bigint, segment bigint, track string, seq bigint, time bigint, seg_time bigint, dur bigint, key boolean, size bigint, width bigint", data)


def test_ring_at_every_push(frame):
    """The rows of the set form equal those of trimming at each push."""
    rng = random.Random(1)
    data, want = [], set()
    for s in range(12):
        for segment in range(2):
            ring, t = [], 0
            for n in range(40):
                t += rng.randrange(1, 5)
                seq = segment * 100 + n
                key = rng.random() < 0.2
                data.append((s, segment, "v", seq, t, t, 1, key, 1, 1))
                ring.append((seq, t, key))
                anchor = 0
                for i, (_, at, k) in enumerate(ring):
                    if at > t - 30:
                        break
                    if k:
                        anchor = i
                ring = ring[anchor:]
            want |= {(s, segment, seq) for seq, _, _ in ring}
    got = {(r.stream_id, r.segment, r.seq) for r in P.ring(stream(frame, data), 30).collect()}
    assert got == want


def test_continuity_by_simulation(frame):
    rng = random.Random(7)
    data, want = [], {}
    for s in range(25):
        shift, end, pending, base, emitted, seq = 0, None, False, None, [], 0
        for segment in range(4):
            if segment:
                pending = end is not None
            t = 0
            for _ in range(rng.randrange(1, 7)):
                t += rng.randrange(0, 9)
                track, key, dur = rng.choice("vvva"), rng.random() < 0.3, rng.randrange(0, 6)
                key = key and track == "v"
                data.append((s, segment, track, seq, t, t, dur, key, 1, 1))
                skip = pending and not key
                if not skip:
                    if pending:
                        shift, pending = end - t, False
                    at = t + shift
                    end = at + dur if end is None else max(end, at + dur)
                    if base is None and key:
                        base = at
                    if track == "a" or base is not None:
                        emitted.append((seq, at))
                seq += 1
        if base is not None:
            want.update({(s, q): at - base for q, at in emitted if at >= base})
    got = {(r.stream_id, r.seq): r.out_time for r in P.continuity(stream(frame, data)).collect()}
    assert got == want


def test_attach_recording_and_replay(frame):
    video = [(0, 0, "v", i, i * 10, i * 10, 10, i in (0, 30, 60), 1, 1) for i in range(70)]
    audio = [(0, 0, "a", 1000 + i, i * 7, i * 7, 7, False, 1, 1) for i in range(100)]
    p = stream(frame, video + audio)
    rec = P.record(frame("request_id bigint, stream_id bigint, at bigint, stop bigint", [(1, 0, 695, 10_000)]), p, span=50)
    assert rec.where("track = 'v'").agg(F.min("seq"), F.count("*"), F.min("out_time")).first() == (60, 10, 0)
    assert rec.where("track = 'a'").agg(F.min("time")).first()[0] == 602
    rep = P.replay(frame("request_id bigint, stream_id bigint, at bigint", [(1, 0, 695), (2, 0, 205), (3, 1, 5)]), p, 300, span=50)
    assert rows(rep.where("track = 'v'").groupBy("request_id").agg(F.min("seq"), F.max("seq"))) == [(1, 30, 69), (2, 0, 20)]


def test_slots(frame):
    p = stream(frame, [(0, 0, "v", i, t, t, 1, False, 1, 1) for i, t in enumerate([1000, 1040, 1100, 1130])])
    assert [r.seq for r in P.slot_select(p, 100).orderBy("seq").collect()] == [0, 2]
    many = stream(frame, [(0, 0, "v", i, i * 10_000_000 // 110, 0, 1, False, 1, 1) for i in range(110)])
    assert 59 <= P.slot_select(many, 166_666).count() <= 61
    kept = frame("stream_id bigint, seq bigint, slot bigint", [(0, 0, 0), (0, 1, 2), (0, 2, 9)])
    assert rows(P.gap_fill(kept, 60), "slot", "source_seq") == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2), (9, 2)]


def test_long_gaps_are_filled_in_blocks(frame, monkeypatch):
    import pandas as pd

    from clipgrove.streaming.processors import GapFill

    # more slots than an array can have
    far = frame("stream_id bigint, seq bigint, slot bigint", [(0, 0, 0), (0, 1, 3_000_000_000)])
    assert P.gap_fill(far, 60).limit(70_000).count() == 70_000
    (slot, _), out = GapFill(3, 60).step(None, pd.DataFrame({"stream_id": [0, 0], "seq": [0, 1], "slot": [0, 3_000_000_000]}))
    assert slot == 3_000_000_000 and next(out)["slot"].tolist() == list(range(1 << 16))
    # a pause of more than fps slots is filled to its end, the same in blocks of any size
    kept = [(0, 0, 5), (0, 1, 300), (0, 2, 302), (0, 3, 303), (0, 4, 400)]
    whole = [(a, b if c - 1 - a >= 3 and at <= c - 2 else b + 1, at) for (_, b, a), (_, _, c) in zip(kept, kept[1:]) for at in range(a + 1, c + 1)]
    want = [(5, 0)] + [(at, seq) for _, seq, at in whole]
    monkeypatch.setattr(P, "FILL_BLOCK", 7)
    monkeypatch.setattr(GapFill, "block", 7)
    assert rows(P.gap_fill(frame("stream_id bigint, seq bigint, slot bigint", kept), 60), "slot", "source_seq") == want
    _, out = GapFill(3, 60).step(None, pd.DataFrame(kept, columns=["stream_id", "seq", "slot"]))
    assert [tuple(r) for r in pd.concat(out)[["slot", "source_seq"]].to_numpy().tolist()] == want


def test_sample_tables(frame):
    from clipgrove.operators import sampletable as T

    t = frame("k bigint, seq bigint, start bigint, own_dur bigint", [(0, 0, 10, 1), (0, 1, 10, 1), (0, 2, 3, 0)])
    assert rows(P.monotone(t, ["k"]), "start") == [(10,), (11,), (12,)]
    d = P.durations(frame("k bigint, seq bigint, start bigint, own_dur bigint", [(0, 0, 0, 1), (0, 1, 1500, 1), (0, 2, 4500, 1500)]), ["k"])
    assert rows(d, "seq", "dur_ticks") == [(0, 1500), (1, 3000), (2, 1500)]
    runs = T.rle(d, ["k"], "dur_ticks")
    assert rows(runs, "first", "n", "dur_ticks") == [(0, 1, 1500), (1, 1, 3000), (2, 1, 1500)]
    chunks = T.rle(frame("k bigint, seq bigint, n bigint", [(0, 1, 3), (0, 2, 3), (0, 3, 2)]).withColumnRenamed("n", "per"), ["k"], "per")
    assert rows(chunks, "first", "per") == [(1, 3), (3, 2)]
    e = frame("clip bigint, i bigint, dur bigint, media_time bigint", [(1, 0, 500, -1), (1, 1, 9, 0), (2, 0, 9, 0), (2, 1, 5, -1), (3, 0, 1, 7)])
    assert rows(T.edit_offset(e)) == [(1, True, 5_000_000), (2, False, 50_000), (3, False, 0)]
    m = frame("clip bigint, first bigint, per_chunk bigint", [(1, 1, 2), (1, 3, 1)])
    c = frame("clip bigint, chunk bigint, offset bigint", [(1, 1, 100), (1, 2, 200), (1, 3, 300)])
    z = frame("clip bigint, sample bigint, size bigint", [(1, i, 10 + i) for i in range(5)])
    assert rows(T.samples_with_offsets(c, m, z), "sample", "chunk", "offset") == [(0, 1, 100), (1, 1, 110), (2, 2, 200), (3, 2, 212), (4, 3, 300)]
    assert T.samples_with_offsets(c, m, z.where("sample < 4")).count() == 0


def test_fps(frame):
    data = []
    for k, step in enumerate([333_333, 416_667, 166_667]):
        data += [(k, i, i * step) for i in range(40)]
    data += [(3, 0, 0), (3, 1, 5), (4, 0, 1), (4, 1, 1), (4, 2, 1)]
    got = P.fps_from_gaps(frame("stream_id bigint, seq bigint, time bigint", data))
    assert rows(got) == [(0, 30), (1, 24), (2, 60), (3, None), (4, None)]


def test_track_layout(frame):
    t = frame("clip bigint, file_no bigint, id string, name string, samples bigint", [
        (1, 0, "mix", "m", 5), (1, 1, "mic", "i", 5), (1, 2, None, "u", 5), (2, 0, None, "s", 5), (3, 0, None, "s", 5), (3, 1, None, "m", 5), (4, 0, None, "s", 0)])
    assert rows(P.track_layout(t), "clip", "track_id", "ordinal", "mix") == [
        (1, "mic", 1, False), (1, "mix", 2, True), (2, "sys", 0, False), (3, "mic", 0, False), (3, "sys", 1, False)]


@pytest.mark.parametrize("seed", range(3))
def test_resize_over_chunks(frame, seed):
    rng = random.Random(seed)
    data, size = [], {}
    for i in range(240):
        k = i % 2
        w, h = size.get(k, (100, 100))
        if rng.random() < 0.7:
            w, h = w + rng.randrange(-14, 15), h + rng.choice([0, 0, rng.randrange(-9, 10)])
        size[k] = (w, h)
        data.append((k, i, w, h))
    df = frame("k bigint, seq bigint, width bigint, height bigint", data)
    got = {r.seq: r.rebuild for r in S.resize_rebuilds(df, ["k"], chunk_rows=13).collect()}
    use = {}
    for k, i, w, h in data:
        want = k not in use or abs(w - use[k][0]) > 16 or abs(h - use[k][1]) > 16
        assert got[i] == want, i
        if want:
            use[k] = (w, h)


def test_expand_deals_blocks_of_one_long_range(spark, frame):
    df = frame("k string, n bigint", [("long", 1_000_000), ("one", 0), ("none", -1), ("null", None)])
    out = expand(df, F.lit(0), F.col("n"), "i", 1000).cache()
    assert out.groupBy("k").agg(F.count("*"), F.min("i"), F.max("i"), F.countDistinct("i")).orderBy("k").collect() == [("long", 1_000_001, 0, 1_000_000, 1_000_001), ("one", 1, 0, 0, 1)]
    out.unpersist()
    long = expand(frame("n bigint", [(50_000_000,)]), F.lit(0), F.col("n"), "i")
    tasks = long.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()
    assert len(tasks) > 1 and max(t.c for t in tasks) < 30_000_000
