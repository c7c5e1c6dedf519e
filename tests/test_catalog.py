import os

from conftest import rows
from pyspark.sql import functions as F

from clipgrove.functions import text
from clipgrove.operators import catalog as C, indexes as X, registry as R
from clipgrove.sources import documents as D


def clips(frame, pairs):
    return frame("path string, modified_ms bigint", pairs)


def test_pages(frame):
    df = clips(frame, [(f"{i:03d}.mp4", (i + 1) * 1000) for i in range(205)])
    both = C.dedup_first(df.withColumn("root", F.lit(0)).unionByName(df.withColumn("root", F.lit(1))), F.lower("path"), [F.col("root"), F.col("path")])
    assert [r.path for r in C.page(both, 0, 100).collect()] == [f"{i:03d}.mp4" for i in range(204, 104, -1)]
    assert C.page_summary(both, 0, 100).first() == (205, 100, True)
    tail = [r.path for r in C.page(both, 200, 100).collect()]
    assert len(tail) == 5 and tail[-1] == "000.mp4"
    assert C.page_summary(both, 200, 100).first() == (205, 5, False)
    assert [r.path for r in C.page(both, 0, 100, oldest=True).collect()] == [f"{i:03d}.mp4" for i in range(100)]
    assert C.page(both, 300, 10).count() == 0 and C.page_summary(both, 300, 10).first() == (205, 0, False)


def test_page_ties_and_deep_page(frame):
    df = clips(frame, [("c", 5), ("a", 5), ("b", 5)])
    assert [C.page(df, i, 1).first().path for i in range(3)] == ["a", "b", "c"]
    assert [r.path for r in C.page(df, 0, None, oldest=True).collect()] == ["c", "b", "a"]
    many = clips(frame, [(f"{i:05d}", i // 7) for i in range(3000)])
    deep = [r.path for r in C.page(many, 1500, 40, top_rows=10).collect()]
    assert deep == [r.path for r in many.orderBy(*C.newest_first()).collect()][1500:1540]


def test_neighbours(frame):
    df = clips(frame, [("a", 3), ("b", 2), ("c", 1)])
    assert rows(C.clip_neighbours(df, C.newest_first()), "path", "prev_path", "next_path") == [("a", None, "b"), ("b", "a", "c"), ("c", "b", None)]


def test_scan_of_roots(spark, tmp_path):
    for name in ("a.mov", "b.M4V", "c.mkv", "d.webm", "e.mp4", "f.avi", "g.txt", "h +%.mp4"):
        (tmp_path / name).write_bytes(b"xy")
    os.mkdir(tmp_path / "sub")
    (tmp_path / "sub" / "deep.mp4").write_bytes(b"x")
    out = D.catalog_scan(spark, [str(tmp_path), str(tmp_path / "missing"), str(tmp_path)])
    assert out.count() == 12
    one = C.dedup_first(out, F.lower("path"), [F.col("root_no"), F.col("path")])
    assert sorted(r.name for r in one.collect()) == ["a", "b", "c", "d", "e", "h +%"]
    r = one.where("name = 'e'").first()
    assert r.path == str(tmp_path / "e.mp4") and r.size_bytes == 2 and r.modified_ms > 0


def test_overlay(frame):
    c = frame("path string, detected string", [(p, "Pantalla 1") for p in "abcd"])
    m = frame("path string, game string, cover string, cover_ms bigint, derived_from string", [
        ("a", "Hades", None, 0, None), ("b", None, "x.png", 7, None), ("c", None, None, 0, "a")])
    assert rows(C.overlay(c, m), "path", "source", "detected", "cover", "cover_ms", "exported") == [
        ("a", "Hades", "Pantalla 1", None, 0, False), ("b", "Pantalla 1", "Pantalla 1", "x.png", 7, False),
        ("c", "Pantalla 1", "Pantalla 1", None, 0, True), ("d", "Pantalla 1", "Pantalla 1", None, 0, False)]


def test_rename_codes(frame):
    req = frame("path string, new_name string", [("/r/a.mp4", "   "), ("/r/a.mp4", "a/b"), ("/r/a.mp4", "a"), ("/r/a.mp4", "b"), ("/r/a.mp4", " new ")])
    cat = frame("path string", [("/r/a.mp4",), ("/r/b.mp4",)])
    assert rows(C.validate_renames(req, cat), "new_name", "code") == [
        ("   ", "empty"), (" new ", "ok"), ("a", "ok"), ("a/b", "chars"), ("b", "exists")]


def test_free_names(frame):
    cat = frame("path string", [("/r/x.mp4",), ("/r/x_2.mp4",), ("/r/x_4.mp4",), ("/r/y.mov",), ("/r/z_1.mp4",)])
    req = frame("req_id bigint, dir string, stem string", [(1, "/r", "x"), (2, "/r", "x"), (3, "/r", "x"), (4, "/r", "y"), (5, "/r", "z"), (6, "/q", "x")])
    assert rows(C.assign_free_names(req, cat), "req_id", "name") == [(1, "x_3"), (2, "x_5"), (3, "x_6"), (4, "y"), (5, "z"), (6, "x")]


def test_badges_and_labels(spark, frame):
    one = spark.range(1)

    def get(c):
        return one.select(c.alias("v")).first().v

    def lit(s):
        return F.lit(s)

    assert get(text.badge_kind(lit("Hades"), lit("c"), lit("i"))) == "cover"
    assert get(text.badge_kind(lit("  "), lit(None), lit("i"))) == "imported"
    assert get(text.badge_kind(lit("Screen 2"), lit(None), lit("i"))) == "screen"
    assert get(text.badge_kind(lit("Screenplay"), lit(""), lit("i"))) == "game"
    assert get(text.badge_kind(lit("Hades"), lit(None), lit(None))) == "initial"
    assert get(text.override_of(lit(" hades "), lit("Hades"))) is None
    assert get(text.override_of(lit(" Celeste "), lit("Hades"))) == "Celeste"
    assert get(text.initial(lit("«élan»"))) == "É" and get(text.initial(lit("!!"))) == "?"
    assert get(text.localize_label(lit("Pantalla 1 · Hades · screen 02"), "Monitor")) == "Monitor 1 · Hades · Monitor 02"
    assert get(text.format_timecode(lit(-5.0))) == "00:00.00"
    assert get(text.format_timecode(lit(61239.0))) == "01:01.23"
    assert get(text.format_duration(lit(3725.9))) == "62:05"
    assert get(text.format_size(lit(1000 * 1024 * 1024))) == "1.0 GB"
    assert get(text.slug(lit("Élan: 2 -- "))) == "lan--2"
    assert get(text.exe_basename(lit(">Bin\\Sub/Game.EXE "))) == "game.exe"
    assert get(text.source_label(lit("x"), lit(None))) == "Pantalla"


def test_index_moves(frame):
    meta = frame("path string, game string, cover string, cover_ms bigint, derived_from string", [
        ("a", "G", None, 0, None), ("e", None, None, 0, "a"), ("b", "old", None, 0, None)])
    edits = frame("path string, v int", [("a", 1), ("b", 2)])
    entries = frame("playlist_id bigint, idx bigint, path string, added_ms bigint, seen boolean", [(1, 0, "a", 5, True), (1, 1, "z", 6, False)])
    moved = X.rekey(edits, meta, entries, frame("old string, new string", [("a", "b")]))
    assert rows(moved["edits"]) == [("b", 1)]
    assert rows(moved["meta"], "path", "game", "derived_from") == [("b", "G", None), ("e", None, "b")]
    assert rows(moved["entries"], "idx", "path") == [(0, "b"), (1, "z")]
    child = X.inherit(meta, frame("child string, parent string", [("n", "a"), ("m", "unknown")]), 9)
    assert rows(child.where("path IN ('n', 'm')"), "path", "game", "derived_from") == [("m", None, "unknown"), ("n", "G", "a")]
    gone = X.forget(edits, meta, entries, frame("path string", [("a",)]))
    assert rows(gone["entries"], "idx", "path") == [(0, "z")] and rows(gone["edits"]) == [("b", 2)]


def test_ranked_search(frame):
    names = ["Valheim", "VALORANT", "Knights of Valor", "Hollow Knight", "valheim", "Interval", "Other"]
    df = frame("idx bigint, name string", list(enumerate(names)))
    assert [r.name for r in R.rank_names(df, " VAL ").collect()] == ["Valheim", "VALORANT", "Knights of Valor", "Interval"]
    assert [r.name for r in R.rank_names(df, "knight").collect()] == ["Knights of Valor", "Hollow Knight"]
    assert R.rank_names(df, "  ").count() == 0


def test_owners_and_filters(frame):
    schema = "idx bigint, name string, exe string, os string, is_launcher boolean, arguments string, icon string"
    df = frame(schema, [
        (0, "A", "bin/shared.exe", "win32", False, None, "ia"), (1, "B", "shared.exe", "", False, None, "ib"), (2, "A", ">x\\own.EXE", None, False, None, None),
        (3, "A", "own.exe", "win32", False, None, "late"), (4, "L", "leagueclientux.exe", "win32", True, None, None), (5, "L", "launch.exe", "win32", True, None, None),
        (6, "J", "javaw.exe", "win32", False, None, None), (7, "P", "p.exe", "win32", False, "-x", None), (8, "D", "d.exe", "darwin", False, None, None), (9, "S", "s.sh", "", False, None, None)])
    assert rows(R.exclusive_owner(R.usable_executables(df))) == [("leagueclientux.exe", "L", None), ("own.exe", "A", None)]


def test_membership_of_asked_pairs_on_a_shared_clip(spark):
    n = 20_000  # all pairs would be 4 * 10^8
    sel = spark.range(n).selectExpr("id AS selection_id", "explode(array(-1L, id)) AS path")
    ent = spark.range(n).selectExpr("id AS playlist_id", "explode(array(-1L, id)) AS path")
    pairs = spark.createDataFrame([(5, 5), (5, 6), (5, 6), (7, n + 1)], "selection_id bigint, playlist_id bigint")
    from clipgrove.operators import playlists

    assert rows(playlists.membership(sel, ent, pairs)) == [(5, 5, "in"), (5, 6, "partial"), (5, 6, "partial"), (7, n + 1, "out")]
