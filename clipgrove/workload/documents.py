"""Queries over files, index documents and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import table, view
from clipgrove.functions import text
from clipgrove.operators import files as Z
from clipgrove.sources import documents as D, entries as E, logs as L
from clipgrove.streaming.drive import scratch
from clipgrove.workload import query

NOW = 1700000000000 + 600 * 3600000
SPAN = 20_000


SQL_OVERLAY = """SELECT concat('/c/', cast(clip_no AS string)) AS path, game, CASE WHEN cover IS NOT NULL THEN cover END AS cover, cast(cover_ms AS bigint) AS cover_ms,
  cast(derived_from_no AS string) AS derived_from FROM fx_overlay"""


def overlay_docs(spark, sf):
    """Each overlay row as a document of its own; absent fields are left out of the text."""
    o = view(spark, sf, "fx_overlay")
    doc = F.to_json(F.create_map(F.concat(F.lit("/c/"), F.col("clip_no").cast("string")), F.struct(
        "game", "cover", F.when(F.col("cover_ms") > 0, F.col("cover_ms")).alias("cover_ms"), F.col("derived_from_no").cast("string").alias("derived_from"))))
    return o.select(F.col("clip_no").cast("string").alias("doc"), doc.alias("value"))


@query("s2_read_overlay_index", SQL_OVERLAY)
def _(spark, sf):
    return D.overlay_rows(overlay_docs(spark, sf))


def large_documents(spark, rows, brackets):
    """Documents of the texts ``entry``, in the order of ``at``, one for every SPAN values of ``at``, each in a file of its own."""
    path = scratch(spark, "document")
    rows = rows.select((F.col("at").cast("bigint")).alias("at"), "entry").withColumn("part", F.floor(F.col("at") / SPAN))
    ends = rows.groupBy("part").agg(F.min("at").alias("least"))
    placed = rows.join(ends, "part").select("part", "at", F.concat(F.when(F.col("at") == F.col("least"), "").otherwise(","), "entry").alias("value"))
    for end, bracket in zip((-1, 2**62), brackets):
        placed = placed.unionByName(ends.select("part", F.lit(end).cast("bigint").alias("at"), F.lit(bracket).alias("value")))
    # a shuffle of its own key: one on ``part`` is left out after the join, whose large partitions are read in several tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(tasks, F.xxhash64("part")).sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("s2_read_large_overlay_index", SQL_OVERLAY)
def _(spark, sf):
    """Overlay rows as large documents, read by ranges."""
    inner = F.regexp_replace("value", r"\A\{|\}\z", "")
    docs = overlay_docs(spark, sf).select(F.col("doc").cast("bigint").alias("at"), inner.alias("entry"))
    return E.read_overlay_index(spark, large_documents(spark, docs, "{}"))


@query("s3_read_edit_index", """SELECT cast(e.clip AS string) AS path, count(s.idx) AS segments, coalesce(sum(s.end_ms), 0) AS end_sum, e.format_kind AS kind, e.brightness,
  CASE WHEN e.clip % 2 = 0 THEN e.sys_vol ELSE 0.25::DOUBLE END AS sys_vol, e.mic_muted FROM fx_edits e LEFT JOIN fx_segments s ON s.clip = e.clip GROUP BY ALL""")
def _(spark, sf):
    """Edits with old scalar volumes; odd clips also carry a sys track, which wins."""
    segs = view(spark, sf, "fx_segments").groupBy("clip").agg(F.collect_list(F.struct("start_ms", "end_ms", "disabled")).alias("segments"))
    e = view(spark, sf, "fx_edits").join(segs, "clip", "left")
    tracks = F.when(F.expr("clip % 2 = 1"), F.create_map(F.lit("sys"), F.struct(F.lit(0.25).alias("vol"), F.lit(False).alias("muted"))))
    mixer = F.struct(tracks.alias("tracks"), "sys_vol", "mic_muted")
    fmt = F.when(F.col("format_kind") == "vertical", F.struct(F.lit("vertical").alias("kind"), F.lit("crop").alias("fill")))
    look = F.when(F.col("brightness") > 0, F.struct("brightness"))
    doc = F.to_json(F.create_map(F.col("clip").cast("string"), F.struct("segments", mixer.alias("mixer"), fmt.alias("format"), look.alias("look"))))
    rows = D.edit_rows(e.select(F.col("clip").cast("string").alias("doc"), doc.alias("value")))
    total = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_ms"])
    return rows.select(
        "path", F.size("segments").cast("bigint").alias("segments"), total.alias("end_sum"), "format.kind", "look.brightness",
        F.col("mixer")["sys"]["vol"].alias("sys_vol"), F.col("mixer")["mic"]["muted"].alias("mic_muted"))


SQL_ENTRY = """SELECT cast(playlist_id AS string) AS playlist_id, idx, concat('/c "', cast(clip_no AS string)) AS path,
  CASE WHEN clip_no % 3 = 0 THEN 0 ELSE added_ms END AS added_ms, CASE WHEN clip_no % 3 = 0 THEN false ELSE seen END AS seen FROM fx_playlist"""


def playlist_docs(spark, sf):
    """One document per playlist; a third of the entries are bare paths."""
    e = view(spark, sf, "fx_playlist")
    path = F.concat(F.lit('/c "'), F.col("clip_no").cast("string"))
    bare = F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('\\"')), F.lit('"'))
    full = F.to_json(F.struct(path.alias("path"), F.when(F.col("added_ms") > 0, F.col("added_ms")).alias("added_ms"), F.when(F.col("seen"), F.lit(True)).alias("seen")))
    one = e.select("playlist_id", F.struct("idx", F.when(F.expr("clip_no % 3 = 0"), bare).otherwise(full).alias("t")).alias("x"))
    lists = one.groupBy("playlist_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("clips"))
    head = F.concat(F.lit('[{"id":"'), F.col("playlist_id").cast("string"), F.lit('","name":"n","created_ms":5,"clips":['), "clips", F.lit("]}]"))
    return lists.select(F.col("playlist_id").cast("string").alias("doc"), head.alias("value"))


@query("s4_read_playlist_index", SQL_ENTRY)
def _(spark, sf):
    return D.playlist_rows(playlist_docs(spark, sf))[1]


@query("s4_read_large_playlist_index", SQL_ENTRY)
def _(spark, sf):
    """Playlists as large documents, read by ranges."""
    inner = F.regexp_replace("value", r"\A\[|\]\z", "")
    docs = playlist_docs(spark, sf).select(F.col("doc").cast("bigint").alias("at"), inner.alias("entry"))
    return E.read_playlist_index(spark, large_documents(spark, docs, "[]"))[1]


SQL_REGISTRY = """SELECT idx, CASE WHEN idx % 4 = 0 THEN '' ELSE cast(idx AS string) END AS id, name, icon_hash, CASE WHEN idx % 3 = 1 THEN idx END AS steam_appid,
  CASE WHEN idx % 2 = 0 THEN concat('x', cast(idx AS string)) END AS xbox_sku FROM fx_registry"""


@query("s5_read_large_registry", SQL_REGISTRY.replace("SELECT idx", f"SELECT cast(row_number() OVER (PARTITION BY idx // {SPAN} ORDER BY idx) - 1 AS int) AS idx", 1))
def _(spark, sf):
    """Games as large documents, read by ranges; a game has the number of its place."""
    inner = F.regexp_replace("value", r"\A\[|\]\z", "")
    docs = registry_texts(spark, sf).select(F.col("doc").cast("bigint").alias("at"), inner.alias("entry"))
    return E.read_registry(spark, large_documents(spark, docs, "[]"))["game"].select("idx", "id", "name", "icon_hash", "steam_appid", "xbox_sku")


@query("s5_read_registry", SQL_REGISTRY)
def _(spark, sf):
    return D.registry_tables(registry_docs(spark, sf))["game"].select("idx", "id", "name", "icon_hash", "steam_appid", "xbox_sku")


@query("s5_read_registry_exes", "SELECT idx, exe, os, is_launcher, arguments FROM fx_registry")
def _(spark, sf):
    return D.registry_tables(registry_docs(spark, sf))["game_exe"].select("idx", "exe", "os", "is_launcher", "arguments")


@query("s5_read_registry_skus", """SELECT idx, 0 AS sku_no, 'steam' AS distributor, CASE WHEN idx % 3 = 1 THEN cast(idx AS string) WHEN idx % 3 = 2 THEN 'x12' END AS id FROM fx_registry
UNION ALL SELECT idx, 1, 'xbox', concat('x', cast(idx AS string)) FROM fx_registry WHERE idx % 2 = 0
UNION ALL SELECT idx, CASE WHEN idx % 2 = 0 THEN 2 ELSE 1 END, 'steam', '7' FROM fx_registry""")
def _(spark, sf):
    return D.registry_tables(registry_docs(spark, sf))["game_sku"]


def registry_texts(spark, sf):
    """Registry entries as JSON text, with nulls and repeated stores inside."""
    r = view(spark, sf, "fx_registry")
    steam = F.expr("CASE WHEN idx % 3 = 1 THEN cast(idx AS string) WHEN idx % 3 = 2 THEN 'x12' END")
    first = F.struct(F.lit("steam").alias("distributor"), steam.alias("id"))
    xbox = F.struct(F.lit("xbox").alias("distributor"), F.concat(F.lit("x"), F.col("idx").cast("string")).alias("id"))
    second = F.struct(F.lit("steam").alias("distributor"), F.lit("7").alias("id"))
    skus = F.when(F.expr("idx % 2 = 0"), F.array(first, xbox, second)).otherwise(F.array(first, second))
    exes = F.array(F.struct(F.col("exe").alias("name"), F.when(F.col("os") != "", F.col("os")).alias("os"), "is_launcher", "arguments"))
    doc = F.to_json(F.array(F.struct(
        F.expr("CASE WHEN idx % 4 <> 0 THEN cast(idx AS string) END AS id"), "name", "icon_hash", exes.alias("executables"), skus.alias("third_party_skus"))), {"ignoreNullFields": "false"})
    return r.select(F.col("idx").cast("string").alias("doc"), doc.alias("value"))


def registry_docs(spark, sf):
    """Registry entries through their JSON text."""
    good, _ = D.split_corrupt(registry_texts(spark, sf), f"array<{D.GAME}>")
    return good.select(F.col("doc").cast("bigint").alias("idx"), F.explode("parsed").alias("g"))


@query("s8_quarantine_bad_documents", """SELECT cast(clip_no AS string) AS doc FROM fx_overlay WHERE clip_no % 3 = 0""")
def _(spark, sf):
    o = view(spark, sf, "fx_overlay")
    # cut off, with text behind it, with a second field behind its end
    end = F.element_at(F.array(F.lit(""), F.lit("}} junk"), F.lit('},"w":{"q":1}')), F.expr("cast(clip_no div 3 % 3 as int) + 1"))
    doc = F.concat(F.lit('{"p":{"game":"g"}'), F.when(F.expr("clip_no % 3 = 0"), end).otherwise("}"))
    return D.split_corrupt(o.select(F.col("clip_no").cast("string").alias("doc"), doc.alias("value")), f"map<string, {D.META}>")[1].select("doc")


@query("s6_read_logs", """SELECT n, substr(line, 1, 23) AS ts, substr(line, 1, 10) AS day, trim(substr(line, 25, 5)) AS level, regexp_extract(substr(line, 31), '^(.*?): ', 1) AS module,
  regexp_extract(substr(line, 31), '^.*?: (.*)$', 1) AS message, CASE WHEN target = 'app' THEN 'app' WHEN starts_with(target, 'app::') THEN substr(target, 6) WHEN target = 'app_other' THEN '_other' ELSE target END AS target_module FROM fx_logs""")
def _(spark, sf):
    return view(spark, sf, "fx_logs").select("n", *L.parse_line(F.col("line")), L.module_of(F.col("target"), "app").alias("target_module"))


@query("f3_target_filter", "SELECT n, target FROM fx_logs WHERE target IN ('app', 'ui') OR starts_with(target, 'app::')")
def _(spark, sf):
    return L.own_logs(view(spark, sf, "fx_logs"), "app").select("n", "target")


@query("w12_byte_budget", """WITH r AS (SELECT substr(line, 1, 10) AS day, n, line, sum(strlen(line) + 1) OVER (PARTITION BY substr(line, 1, 10) ORDER BY n) AS b FROM fx_logs)
SELECT day, n, line, false AS notice FROM r WHERE b <= 9000
UNION ALL SELECT day, min(n), concat(day, ' 23:59:59.999 WARN  logs: day limit of 9000 bytes reached'), true FROM r WHERE b > 9000 GROUP BY day""")
def _(spark, sf):
    lines = view(spark, sf, "fx_logs").select(F.substring("line", 1, 10).alias("day"), "n", "line")
    return L.byte_budget(lines, 9000)


@query("w11_keep_last_n", """WITH f AS (SELECT DISTINCT concat('log-', substr(line, 1, 10), '.log') AS name FROM fx_logs UNION ALL SELECT DISTINCT concat('other-', substr(line, 1, 10)) FROM fx_logs)
SELECT name FROM f WHERE name LIKE 'other-%' OR name IN (SELECT name FROM f WHERE name LIKE 'log-%' ORDER BY name DESC LIMIT 7)""")
def _(spark, sf):
    day = F.substring("line", 1, 10)
    logs = view(spark, sf, "fx_logs")
    names = logs.select(F.concat(F.lit("log-"), day, F.lit(".log")).alias("name")).distinct().unionByName(logs.select(F.concat(F.lit("other-"), day).alias("name")).distinct())
    return L.keep_last(names)


@query("p35_log_message_shape", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, left(array_to_string(p[1:4], ' | '), 2000) AS message FROM l""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shape_message(F.col("text")).alias("message"))


@query("a1_usage_by_kind", """WITH k AS (SELECT DISTINCT kind FROM fx_files UNION ALL SELECT 'unused'), u AS (SELECT k.kind, cast(coalesce(sum(bytes), 0) AS bigint) AS bytes FROM k LEFT JOIN fx_files f ON f.kind = k.kind GROUP BY 1)
SELECT kind, bytes FROM u UNION ALL SELECT NULL, cast(sum(bytes) AS bigint) FROM u""")
def _(spark, sf):
    f = view(spark, sf, "fx_files")
    kinds = f.select("kind").distinct().unionByName(spark.sql("SELECT 'unused' AS kind"))
    return Z.usage(f, kinds)


@query("f6_stale_files", f"SELECT doc_id, path FROM fx_files WHERE {NOW} - mtime_ms > 604800000")
def _(spark, sf):
    return Z.stale(view(spark, sf, "fx_files"), NOW).select("doc_id", "path")
