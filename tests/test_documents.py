import json
import random

import pytest
from conftest import rows
from pyspark.sql import SparkSession, functions as F

from clipgrove.functions import edits as E
from clipgrove.operators import files as Z, registry as R
from clipgrove.sources import documents as D, entries as EN, logs as L, versions as V


def test_playlist_index(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text('[{"id":"p1","name":"n","created_ms":3,"clips":["a","{b",{"path":"c","added_ms":9,"seen":true},{"path":"d"}]},{"id":"p2","name":"m","created_ms":4,"pos":2,"clips":[]}]')
    lists, entries = D.read_playlist_index(spark, str(f))
    assert rows(lists, "playlist_id", "description", "cover_ms", "pos") == [("p1", "", 0, None), ("p2", "", 0, 2)]
    assert rows(entries) == [("p1", 0, "a", 0, False), ("p1", 1, "{b", 0, False), ("p1", 2, "c", 9, True), ("p1", 3, "d", 0, False)]


def test_overlay_index_and_quarantine(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"x":{"game":"G"},"y":{"cover":"c","cover_ms":4,"other":1}}')
    bad.write_text('{"x":{"game":')
    out = D.read_overlay_index(spark, [str(good), str(bad), str(tmp_path / "none.json")])
    assert rows(out) == [("x", "G", None, 0, None), ("y", None, "c", 4, None)]
    _, broken = D.split_corrupt(D.read_documents(spark, [str(good), str(bad)]), f"map<string, {D.META}>")
    D.quarantine(broken, str(tmp_path / "aside"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "aside")).collect()] == ['{"x":{"game":']


def test_edit_index_legacy_mixer(spark, tmp_path):
    f = tmp_path / "e.json"
    f.write_text('{"a":{"segments":[],"mixer":{"sys_vol":0.5,"mic_vol":0.8,"mic_muted":true}},'
                 '"b":{"segments":[{"start_ms":0,"end_ms":9}],"mixer":{"tracks":{"sys":{"vol":0.25,"muted":false}},"sys_vol":1},"format":{"kind":"vertical","fill":"fit"},"look":{"contrast":0.5}}}')
    df = D.read_edit_index(spark, str(f))
    gains = [E.track_gain(F.col("mixer"), t).alias(t) for t in ("sys", "mic", "app")]
    assert rows(df.select("path", *gains, "format.kind", "look.contrast", F.size("segments"))) == [
        ("a", 0.5, 0.0, 1.0, "horizontal", 0.0, 0), ("b", 0.25, 1.0, 1.0, "vertical", 0.5, 1)]


def test_registry(spark, tmp_path):
    f = tmp_path / "g.json"
    f.write_text('[{"id":"1","name":" Hades ","icon_hash":"h","executables":[{"name":"h.exe"}],"third_party_skus":[{"distributor":"steam","id":null},{"distributor":"steam","id":"5"}]},'
                 '{"id":"2","name":"hades","icon_hash":"z"},{"name":"No id","icon_hash":"q"},{"id":"4","name":"S","third_party_skus":[{"distributor":"steam","id":"70"},{"distributor":"xbox","id":"X"}]}]')
    t = D.read_registry(spark, str(f))
    assert rows(t["game"], "idx", "id", "lower", "steam_appid", "xbox_sku") == [
        (0, "1", "hades", None, None), (1, "2", "hades", None, None), (2, "", "no id", None, None), (3, "4", "s", 70, "X")]
    assert rows(t["game_exe"], "idx", "exe", "os", "is_launcher") == [(0, "h.exe", "", False)]
    asked = spark.createDataFrame([("  HADES",), ("no ID ",), ("s",), ("none",)], "name string")
    assert rows(R.registry_lookup(asked, t["game"], "u/"), "name", "icon_url", "steam_appid") == [
        ("  HADES", "u/1/h.png", None), ("no ID ", None, None), ("none", None, None), ("s", None, 70)]


def test_logs(spark, frame, tmp_path):
    lines = [(i, "2024-01-02 10:00:00.000 INFO  app: " + "x" * (1 << 20)) for i in range(8)]
    out = L.byte_budget(frame("n bigint, line string", lines).withColumn("day", F.substring("line", 1, 10)), 5 << 20)
    assert rows(out, "n", "notice") == [(0, False), (1, False), (2, False), (3, False), (4, True)]
    assert out.where("notice").first().line.startswith("2024-01-02 23:59:59.999 WARN  logs:")
    names = frame("name string", [(f"log-2024-01-0{d}.log",) for d in range(1, 10)] + [("notes.txt",)])
    assert [r[0] for r in rows(L.keep_last(names))] == [f"log-2024-01-0{d}.log" for d in range(3, 10)] + ["notes.txt"]
    days = frame("n bigint, line string", [(d, f"2024-01-0{d} 10:00:00.000 ERROR ui: two\nlines: {d}") for d in range(1, 10)])
    L.write_daily(days, str(tmp_path / "logs"))
    back = L.read_daily(spark, str(tmp_path / "logs"))
    assert sorted(str(r.day) for r in back.select("day").distinct().collect()) == [f"2024-01-0{d}" for d in range(3, 10)]
    got = back.select(*L.parse_line(F.col("line"))).where("day = '2024-01-09'").first()
    assert (got.ts, got.level, got.module, got.message) == ("2024-01-09 10:00:00.000", "ERROR", "ui", "two\nlines: 9")


def test_usage_and_age(frame):
    f = frame("kind string, bytes bigint, mtime_ms bigint", [("a", 10, 0), ("a", 5, None), ("b", 1, 8 * Z.DAY_MS)])
    assert rows(Z.usage(f, frame("kind string", [("a",), ("b",), ("c",)]))) == [("a", 15), ("b", 1), ("c", 0), (None, 16)]
    assert rows(Z.stale(f, 8 * Z.DAY_MS), "bytes") == [(10,)]


def test_daily_log_appends_within_the_budget(frame, tmp_path):
    day = "2024-05-01 10:00:00.000 INFO  a: "
    lines = [(i, day + "x" * 20) for i in range(30)]
    size = len(lines[0][1]) + 1
    path = str(tmp_path / "logs")
    read = lambda: sorted((r.n, r.notice) for r in L.read_daily(SparkSession.active(), path).collect())
    df = frame("n bigint, line string", lines)
    L.write_daily(df.where("n < 5"), path, 12 * size)
    assert [n for n, _ in read()] == [0, 1, 2, 3, 4]
    L.write_daily(df.where("n >= 5 AND n < 9"), path, 12 * size)
    L.write_daily(df.where("n >= 9 AND n < 20"), path, 12 * size)
    assert read() == [(n, False) for n in range(12)] + [(12, True)]
    L.write_daily(df.where("n >= 20"), path, 12 * size)
    assert len(read()) == 13


def test_daily_log_counts_a_repeated_call_once(spark, frame, tmp_path, monkeypatch):
    day = "2024-05-0{} 10:00:00.000 INFO  a: x"
    lines = [(i, day.format(1 + i % 9)) for i in range(180)]
    df, path = frame("n bigint, line string", lines), str(tmp_path / "logs")
    part = lambda k: df.where(f"n div 10 = {k}")
    commit = L.Versions.commit

    def broken(self, state):
        raise OSError("lost")

    for k in range(18):
        with monkeypatch.context() as m:
            m.setattr(L.Versions, "commit", broken)
            with pytest.raises(OSError):
                L.write_daily(part(k), path, batch=k)
        assert L.Versions.commit is commit
        assert L.write_daily(part(k), path, batch=k) and not L.write_daily(part(k), path, batch=k)
        got = sorted(r.n for r in L.read_daily(spark, path).collect())
        seen = [n for n in range(10 * k + 10)]
        days = sorted({1 + n % 9 for n in seen})[-7:]
        assert got == [n for n in seen if 1 + n % 9 in days]
    table = L.Versions(spark, path)
    assert len(table.numbers()) == 2 and len(table.state["lines"]) < L.COMPACT and len(table._names(f"{path}/data")) <= L.COMPACT + 1


def test_keyed_table_rewrites_touched_buckets_only(spark, frame, tmp_path, monkeypatch):
    table = V.KeyedTable(spark, str(tmp_path / "t"), "k string, v bigint", ["k"], buckets=8)
    fold = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    first = frame("k string, v bigint", [(f"k{i}", i) for i in range(100)])
    assert table.merge(0, first, fold)
    before = set(table.versions.state["live"])
    with monkeypatch.context() as m:
        m.setattr(V.Versions, "commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(1, frame("k string, v bigint", [("k1", 5)]), fold)
    assert table.merge(1, frame("k string, v bigint", [("k1", 5)]), fold)
    assert not table.merge(1, frame("k string, v bigint", [("k1", 5)]), fold)
    assert len(before - set(table.versions.state["live"])) == 1
    assert rows(table.read()) == sorted([(f"k{i}", i + (5 if i == 1 else 0)) for i in range(100)])
    for number in range(2, 6):
        table.merge(number, frame("k string, v bigint", [("k1", 1), ("new", 1)]), fold)
    assert rows(table.read().where("k IN ('k1', 'new')")) == [("k1", 10), ("new", 4)]
    live = {f.partition("/")[0] for f in table.versions.state["live"]}
    assert set(table.versions._names(f"{tmp_path}/t/data")) <= live | {"b4"}


def test_budget_and_retention_per_machine(frame, tmp_path):
    day = "2024-05-{:02d} 10:00:00.000 INFO  a: x"
    rows_ = [(h, h * 1000 + d, day.format(d)) for h in (1, 2) for d in range(1, 11 if h == 1 else 4)]
    path = str(tmp_path / "logs")
    L.write_daily(frame("host bigint, n bigint, line string", rows_), path, machine="host")
    got = {(r.host, str(r.day)) for r in L.read_daily(SparkSession.active(), path).collect()}
    assert got == {(1, f"2024-05-{d:02d}") for d in range(4, 11)} | {(2, f"2024-05-{d:02d}") for d in range(1, 4)}


def test_text_behind_a_document(frame):
    docs = [("a", '{"p":{"game":"g"}}'), ("b", '{"p":{"game":"g"}}} junk'), ("c", '{"p":{"game":"g"}},"w":{"q":1}'), ("d", '{"p":{"game":"g"}} x'),
            ("e", '{"p":{"game":"g"}}], ['), ("f", ""), ("g", None), ("h", ' {"p":{"game":"g"}}\n'), ("i", '{"p":{"game":"g"}},{}'), ("j", '{"p":')]
    good, bad = D.split_corrupt(frame("doc string, value string", docs), f"map<string, {D.META}>")
    assert [r[0] for r in rows(good, "doc")] == ["a", "h"] and [r[0] for r in rows(bad, "doc")] == list("bcdefgij")


@pytest.fixture()
def tiny_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, "64")
    yield
    for n in names:
        spark.conf.unset(n)


def test_entries_of_large_documents(spark, tmp_path, tiny_ranges):
    r = random.Random(3)
    odd = ['a,b', 'q"{', '\\', '[,]', 'é,\n', '', '}', '\\"', 'x' * 90]

    def value(d):
        if d == 0 or r.random() < 0.4:
            return r.choice([*odd, 1, None, True, -2.5])
        return {r.choice(odd) + str(i): value(d - 1) for i in range(r.randrange(3))} if r.random() < 0.5 else [value(d - 1) for _ in range(r.randrange(3))]

    texts = []
    for i in range(14):
        doc = {f"{r.choice(odd)}{k}": {"game": r.choice(odd), "cover_ms": k, "other": value(3)} for k in range(r.randrange(6))}
        t = json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (" , ", " : ")]))
        if i % 2:
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", ",", '"', "}", "{", "\\", "]"]) + t[at + r.randrange(2):]
        texts.append(t)
    texts += ["", " ", "{}", " {\n} ", "{},", "{,}", '{"a":{},}', '{"a":{}},', '{"a":{}} x', '{"a":{},"a":{}}', '{"a":{},"b":{},"a":{}}', "[]", '{"a":{}}{"b":{}}', '{"a":{}},"b":{}}', "null", '{"a":[}', '"{', '{"a":1,"b":{}}']
    for i, t in enumerate(texts):
        (tmp_path / f"{i:02d}.json").write_text(t)
    schema = f"map<string, {D.META}>"
    good, bad = D.split_corrupt(D.read_documents(spark, str(tmp_path)), schema)
    parts, broken = EN.split_documents(spark, str(tmp_path), schema)
    assert rows(broken) == rows(bad, "doc")
    want = rows(D.overlay_rows(D.read_documents(spark, str(tmp_path))))
    assert len(want) > 15 and rows(D.overlay_rows(parts)) == want
    assert {r[0] for r in rows(parts, "doc")} == {r[0] for r in rows(good, "doc")}
    assert EN.split_documents(spark, str(tmp_path / "none"), schema)[0].count() == 0


def test_large_registry_keeps_places(spark, tmp_path, tiny_ranges):
    games = [{"id": str(i), "name": f"g,{i} [", "executables": [{"name": "a,b.exe"}] * (i % 3)} for i in range(50)]
    (tmp_path / "g.json").write_text(json.dumps(games, indent=1))
    a, b = EN.read_registry(spark, str(tmp_path / "g.json")), D.read_registry(spark, str(tmp_path / "g.json"))
    for name, n in {"game": 50, "game_exe": 49}.items():
        assert len(rows(a[name])) == n and rows(a[name]) == rows(b[name])
    assert EN.pieces(spark, [str(tmp_path / "g.json")]).select("block").distinct().count() > 20


def test_entries_move_as_chunks(spark, tmp_path):
    """Commas inside an entry are no rows, wherever chunks are cut."""
    lists = [{"id": f"p{i}", "name": 'a,"[b', "clips": [f'c,{k}\\"' for k in range(20)]} for i in range(200)]
    path = str(tmp_path / "p.json")
    (tmp_path / "p.json").write_text(json.dumps(lists))
    assert EN.pieces(spark, [path]).count() == 200
    small = EN.pieces(spark, [path], 300)
    assert small.groupBy("entry").count().count() == 200 and small.where("final").select("entry").distinct().collect()[0][0] == 199
    # every chunk holds one batch of pieces at least, so the batches are made small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = EN.pieces(spark, [path], 1).collect()
        assert len(cut) > 400 and len({r.chunk for r in cut}) > 500
        texts = {}
        for r in sorted(cut, key=lambda r: (r.block, r.chunk)):
            texts[r.entry] = texts.get(r.entry, b"") + bytes(r.value)
        assert [*json.loads(",".join(texts[i].decode() for i in range(200)))] == lists
        assert rows(EN.read_playlist_index(spark, path)[1]) == rows(D.read_playlist_index(spark, path)[1])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
