from conftest import rows
from pyspark.sql import functions as F

from clipgrove.functions import edits as E, planning as N
from clipgrove.operators import playlists as L, processes as Q, segments as S

SCHEMA = "clip bigint, idx bigint, start_ms double, end_ms double, pos_ms double, bound_start_ms double, bound_end_ms double, disabled boolean"


def segs(frame, *blocks):
    """blocks (start, end, pos[, disabled]) of clip 1, bounded by 0 .. 10000."""
    return frame(SCHEMA, [(1, i, float(b[0]), float(b[1]), float(b[2]), 0.0, 10000.0, len(b) > 3 and b[3]) for i, b in enumerate(blocks)])


def times(df):
    return [(r.start_ms, r.end_ms, r.pos_ms) for r in df.orderBy("idx").collect()]


def test_split(frame):
    s = segs(frame, (0, 1000, 0), (2000, 3000, 1500))
    out = S.split_at(s, frame("clip bigint, index bigint, src_ms double", [(1, 0, 400.0)]))
    assert times(out) == [(0, 400, 0), (400, 1000, 400), (2000, 3000, 1500)]
    first = out.orderBy("idx").first()
    assert (first.bound_start_ms, first.bound_end_ms) == (0.0, 400.0)
    assert times(S.split_at(s, frame("clip bigint, index bigint, src_ms double", [(1, 0, 49.0)]))) == times(s)


def test_trim(frame):
    s = segs(frame, (0, 1000, 0), (2000, 3000, 1200))
    req = "clip bigint, index bigint, edge string, src_ms double"
    assert times(S.trim(s, frame(req, [(1, 1, "start", 100.0)])))[1] == (1800, 3000, 1000)
    assert times(S.trim(s, frame(req, [(1, 1, "start", 2990.0)])))[1] == (2950, 3000, 2150)
    assert times(S.trim(s, frame(req, [(1, 0, "end", -5.0)])))[0] == (0, 50, 0)
    assert times(S.trim(s, frame(req, [(1, 0, "end", 99999.0)])))[0] == (0, 10000, 0)


def test_remove_range(frame):
    s = segs(frame, (0, 1000, 0), (2000, 3000, 1000))
    req = "clip bigint, from_pos double, to_pos double"
    assert times(S.remove_range(s, frame(req, [(1, 400.0, 600.0)]))) == [(0, 400, 0), (600, 1000, 400), (2000, 3000, 800)]
    assert times(S.remove_range(s, frame(req, [(1, 0.0, 5000.0)]))) == times(s)
    assert times(S.remove_range(s, frame(req, [(1, 500.0, 500.5)]))) == times(s)
    assert times(S.remove_range(s, frame(req, [(1, 970.0, 1970.0)]))) == [(0, 970, 0)]


def test_gaps_and_moves(frame):
    s = segs(frame, (0, 1000, 0), (0, 500, 2000), (0, 300, 4000))
    assert rows(S.free_gaps(s, frame("clip bigint, extent_ms double", [(1, 6000.0)])), "gap_from", "gap_to") == [(1000.0, 2000.0), (2500.0, 4000.0), (4300.0, 6000.0)]
    req = "clip bigint, index bigint, desired double, extent_ms double, snap_ms double, playhead double"

    def move(*r):
        row = S.move_to(s, frame(req, [(1, *r)])).where(F.col("idx") == r[0]).first()
        return row.pos_ms, row.snapped_at

    assert move(2, 1200.0, 6000.0, 0.0, 0.0) == (1200.0, None)
    assert move(2, 1690.0, 6000.0, 20.0, 9000.0) == (1700.0, 2000.0)
    assert move(2, 1300.0, 6000.0, 20.0, 1310.0) == (1310.0, 1310.0)
    assert move(0, 1700.0, 3000.0, 0.0, 0.0) == (1000.0, None)
    assert move(0, 1900.0, 3000.0, 0.0, 0.0) == (2500.0, None)
    assert S.move_to(segs(frame, (0, 1000, 0), (0, 500, 900)), frame(req, [(1, 0, 100.0, 1400.0, 0.0, 0.0)])).where("idx = 0").first().pos_ms == 0.0


def test_snap_ties(frame):
    t = frame("clip bigint, target double, no bigint", [(1, 90.0, 0), (1, 110.0, 1), (1, 300.0, 2)])
    v = frame("clip bigint, value double", [(1, 100.0), (1, 250.0), (1, 291.0)])
    assert rows(S.snap(v, t, 10.0), "value", "snapped", "at") == [(100.0, 110.0, 110.0), (250.0, 250.0, None), (291.0, 300.0, 300.0)]


def test_mapping(frame):
    s = segs(frame, (100, 600, 0), (1000, 2000, 800, True), (3000, 3500, 2000))
    q = frame("clip bigint, out_ms double", [(1, -5.0), (1, 0.0), (1, 499.0), (1, 500.0), (1, 5000.0), (2, 1.0)])
    assert rows(S.out_to_src(q, s), "clip", "out_ms", "idx", "src_ms") == [
        (1, -5.0, 0, 100.0), (1, 0.0, 0, 100.0), (1, 499.0, 0, 599.0), (1, 500.0, 2, 3000.0), (1, 5000.0, 2, 3500.0), (2, 1.0, 0, 0.0)]
    p = frame("clip bigint, pos double", [(1, 200.0), (1, 700.0), (1, 1250.0), (1, 1251.0), (1, 2100.0), (1, 9000.0)])
    assert rows(S.pos_to_out(p, s), "pos", "out_ms") == [(200.0, 200.0), (700.0, 500.0), (1250.0, 500.0), (1251.0, 500.0), (2100.0, 600.0), (9000.0, 1000.0)]
    off = segs(frame, (0, 1000, 0), (3000, 4000, 1000))
    assert rows(S.segment_offsets(off), "s", "e", "shift") == [(0, 10_000_000, 0), (30_000_000, 40_000_000, 20_000_000)]


def test_noop(frame):
    edits = frame("clip bigint, format_kind string, brightness double, sys_vol double, mic_muted boolean", [
        (1, "horizontal", 0.0, 1.0, False), (2, "vertical", 0.0, 1.0, False), (3, "horizontal", 0.2, 1.0, False), (4, "horizontal", 0.0, 0.5, False),
        (5, "horizontal", 0.0, 1.0, True), (6, "horizontal", 0.0, 1.0, False), (7, "horizontal", 0.0, 1.0, False)])
    one = [(c, 0, 0.4, 1000.0, 77.0, 0.0, 1000.0, False) for c in range(1, 6)] + [(6, 0, 5.0, 1000.0, 0.0, 0.0, 1000.0, False), (7, 0, 0.0, 1000.0, 0.0, None, None, False)]
    got = S.with_noop(edits, frame(SCHEMA, one))
    assert [r[0] for r in rows(got.where("noop"), "clip")] == [1]


def test_share_plan(spark):
    def plan(mb, secs, w=1920, h=1080, fps=60, src=50_000_000):
        p = N.share_plan(F.lit(mb * 1048576), F.lit(float(secs)), F.lit(w), F.lit(h), F.lit(fps), F.lit(src))
        return tuple(spark.range(1).select(p.alias("p")).first().p)

    assert plan(10, 60)[1] == 720
    assert plan(10, 900) == (300_000, 480)
    assert plan(100, 1, src=8_000_000) == (8_000_000, None)
    one = spark.range(1).select(
        N.target_bitrate(F.lit(640), F.lit(480), F.lit(20), F.lit("low")).alias("low"), N.target_bitrate(F.lit(3840), F.lit(2160), F.lit(240), F.lit("ultra")).alias("top"),
        N.peak_bitrate(F.lit(20_000_000)).alias("peak"), N.output_dims(F.lit(2560), F.lit(1440), F.lit(1080)).alias("d"), N.output_dims(F.lit(1280), F.lit(720), F.lit(1080)).alias("n")).first()
    assert (one.low, one.top, one.peak) == (1_000_000, 150_000_000, 35_000_000)
    assert tuple(one.d) == (1920, 1080) and tuple(one.n) == (1280, 720)


def test_playlists(frame):
    e = frame("playlist_id bigint, idx bigint, path string, added_ms bigint, seen boolean", [(1, i, p, 10 + i, i == 0) for i, p in enumerate("abcd")])
    req = "playlist_id bigint, place bigint, path string"
    assert rows(L.add_entries(e, frame(req, [(1, 0, "b"), (1, 1, "x"), (1, 2, "x"), (2, 0, "y")]), 99, frame("playlist_id bigint", [(1,)])), "idx", "path", "added_ms")[-1] == (4, "x", 99)
    left = L.remove_entries(e, frame("playlist_id bigint, path string", [(1, "b"), (1, "d")]))
    assert rows(left, "idx", "path") == [(0, "a"), (1, "c")]
    back = frame("playlist_id bigint, old_idx bigint, path string, added_ms bigint, seen boolean", [(1, 1, "b", 11, False), (1, 3, "d", 13, False), (1, 9, "c", 1, True)])
    assert rows(L.restore_entries(left, back), "idx", "path", "added_ms") == [(0, "a", 10), (1, "b", 11), (2, "c", 12), (3, "d", 13)]
    order = L.set_order(e, frame(req, [(1, 0, "d"), (1, 1, "new"), (1, 2, "a")]), 99)
    assert rows(order, "idx", "path", "added_ms", "seen") == [(0, "d", 13, False), (1, "new", 99, False), (2, "a", 10, True)]
    shown = L.reorder_visible(e, frame(req, [(1, 0, "c"), (1, 1, "a")]))
    assert rows(shown, "place", "path") == [(0, "c"), (1, "a"), (2, "b"), (3, "d")]
    lists = frame("playlist_id bigint, pos bigint", [(1, 0), (2, None), (3, 1)])
    assert rows(L.reorder_playlists(lists, frame("playlist_id bigint, place bigint", [(3, 0), (2, 1)]))) == [(1, None), (2, 1), (3, 0)]


def test_process_trees(frame):
    schema = "pid bigint, parent bigint, exe string"
    p = frame(schema, [(1, 0, "explorer.exe"), (10, 1, "chat.exe"), (11, 10, "chat.exe"), (12, 11, "chat.exe"), (20, 10, "game.exe"), (30, 1, "music.exe"), (40, 41, "a.exe"), (41, 40, "b.exe")])
    assert rows(Q.process_roots(p, ["chat.exe", None], 20)) == [(10, 0)]
    assert rows(Q.process_roots(p, [None, "music.exe"], 20)) == [(20, 0), (30, 1)]
    assert rows(Q.process_roots(p, ["a.exe"])) == [(40, 0)]
    w = frame(schema, [(1, 0, "explorer.exe"), (2, 1, "teams.exe"), (3, 2, "msedgewebview2.exe"), (4, 3, "msedgewebview2.exe"), (9, 1, "own.exe"), (8, 9, "msedgewebview2.exe"), (7, 99, "msedgewebview2.exe")])
    assert rows(Q.session_owner(w, 9)) == [(1, 1), (2, 2), (3, 2), (4, 2), (7, 99), (8, None), (9, None)]
    deep = frame(schema, [(i, i - 1, "x.exe" if i > 1 else "root.exe") for i in range(1, 60)])
    assert rows(Q.process_roots(deep.withColumn("exe", F.when(F.col("pid") == 55, "leaf.exe").otherwise(F.col("exe"))), ["root.exe", "leaf.exe"])) == [(1, 0)]
