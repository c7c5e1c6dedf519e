"""Queries of the clip catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import view
from clipgrove.functions import text
from clipgrove.operators import catalog as C
from clipgrove.operators.segments import edited_keys
from clipgrove.plans.library import library_clips, library_page
from clipgrove.workload import query

NOW = 1700050000000

# Overlay rows of fx_overlay in the shape of the overlay table.
SQL_META = """meta AS (SELECT clip_no, trim(game) AS game, cover, cast(cover_ms AS bigint) AS cover_ms, derived_from_no AS derived_from FROM fx_overlay)"""
SQL_CLIPS = """clips AS (SELECT * FROM fx_clips WHERE lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN ('mp4','mov','m4v','mkv','webm'))"""
SQL_EDITED = """edited AS (
  SELECT e.clip FROM fx_edits e LEFT JOIN (
    SELECT clip, count(*) AS n, bool_and(NOT disabled AND abs(start_ms - bound_start_ms) < 1 AND abs(end_ms - bound_end_ms) < 1) AS whole
    FROM fx_segments GROUP BY clip) s ON e.clip = s.clip
  WHERE NOT (format_kind = 'horizontal' AND abs(brightness) < 0.001 AND NOT mic_muted AND abs(sys_vol - 1) <= 0.00000011920929
    AND (n IS NULL OR (n = 1 AND whole))))"""
SQL_LIBRARY = f"""{SQL_META}, {SQL_CLIPS}, {SQL_EDITED}, library AS (
  SELECT c.clip_no, c.path, c.title, c.size_bytes, c.modified_ms, c.duration_sec, c.detected,
    coalesce(m.game, c.detected) AS source, m.cover, coalesce(m.cover_ms, 0) AS cover_ms,
    m.derived_from IS NOT NULL AS exported, e.clip IS NOT NULL AS edited
  FROM clips c LEFT JOIN meta m ON c.clip_no = m.clip_no LEFT JOIN edited e ON c.clip_no = e.clip)"""


def clips(spark, sf):
    c = view(spark, sf, "fx_clips")
    return c.where(text.file_ext(F.col("path")).isin("mp4", "mov", "m4v", "mkv", "webm"))


def meta(spark, sf):
    return view(spark, sf, "fx_overlay").select(
        "clip_no", text.strip(F.col("game")).alias("game"), "cover", F.col("cover_ms").cast("bigint").alias("cover_ms"),
        F.col("derived_from_no").alias("derived_from"))


def library(spark, sf):
    done = edited_keys(view(spark, sf, "fx_edits"), view(spark, sf, "fx_segments")).withColumnRenamed("clip", "clip_no")
    return library_clips(clips(spark, sf), meta(spark, sf), done, "clip_no").select(
        "clip_no", "path", "title", "size_bytes", "modified_ms", "duration_sec", "detected", "source", "cover", "cover_ms",
        "exported", "edited")


@query("catalog_page", f"""WITH {SQL_LIBRARY}
SELECT * FROM library WHERE edited OR exported OR source = 'Brand#12'
ORDER BY modified_ms DESC, path LIMIT 100""")
def _(spark, sf):
    return library_page(library(spark, sf), edited=True, sources=["Brand#12"], limit=100)


@query("t1_page", f"""WITH {SQL_CLIPS}
SELECT path, modified_ms FROM clips ORDER BY modified_ms DESC, path LIMIT 50 OFFSET 100""")
def _(spark, sf):
    return C.page(clips(spark, sf).select("path", "modified_ms"), 100, 50)


@query("t1_page_oldest", f"""WITH {SQL_CLIPS}
SELECT path, modified_ms FROM clips ORDER BY modified_ms, path DESC LIMIT 50 OFFSET 25""")
def _(spark, sf):
    return C.page(clips(spark, sf).select("path", "modified_ms"), 25, 50, oldest=True)


@query("t1_page_positions", f"""WITH {SQL_CLIPS}
SELECT path, row_number() OVER (ORDER BY modified_ms DESC, path) - 1 AS pos FROM clips""")
def _(spark, sf):
    return C.ordinal(clips(spark, sf).select("path", "modified_ms"), C.newest_first()).select("path", "pos")


@query("t1_page_summary", f"""WITH {SQL_CLIPS}
SELECT count(*) AS total, least(greatest(count(*) - 100, 0), 50) AS rows, 100 + least(greatest(count(*) - 100, 0), 50) < count(*) AS has_more FROM clips""")
def _(spark, sf):
    return C.page_summary(clips(spark, sf), 100, 50)


@query("w10_dedup_first", f"""WITH {SQL_CLIPS}, scans AS (
  SELECT 0 AS root, path, clip_no, size_bytes FROM clips
  UNION ALL SELECT 1, upper(path), clip_no, size_bytes + 1 FROM clips)
SELECT root, path, clip_no, size_bytes FROM scans QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY root, clip_no) = 1""")
def _(spark, sf):
    c = clips(spark, sf).select(F.lit(0).alias("root"), "path", "clip_no", "size_bytes")
    again = c.select(F.lit(1).alias("root"), F.upper("path").alias("path"), "clip_no", (F.col("size_bytes") + 1).alias("size_bytes"))
    return C.dedup_first(c.unionByName(again), F.lower("path"), [F.col("root"), F.col("clip_no")])


@query("u1_union_roots", """WITH lists AS (
  SELECT 0 AS list_no, clip_no AS idx, concat('/', detected) AS path FROM fx_clips
  UNION ALL SELECT 1, clip_no, concat('/', lower(title), ' ') FROM fx_clips
  UNION ALL SELECT 2, clip_no, concat('/', upper(title)) FROM fx_clips)
SELECT trim(path) AS path, list_no, idx FROM lists
QUALIFY row_number() OVER (PARTITION BY lower(trim(path)) ORDER BY list_no, idx) = 1""")
def _(spark, sf):
    c = view(spark, sf, "fx_clips")

    def roots(name):
        return c.select(F.concat(F.lit("/"), name).alias("path"), F.col("clip_no").alias("idx"))

    return C.union_roots(roots(F.col("detected")), roots(F.concat(F.lower("title"), F.lit(" "))), roots(F.upper("title")))


@query("u8_append_page", f"""WITH {SQL_CLIPS}, placed AS (
  SELECT path, modified_ms, row_number() OVER (ORDER BY modified_ms DESC, path) - 1 AS pos FROM clips),
pages AS (SELECT 0 AS page, * FROM placed WHERE pos < 200 UNION ALL SELECT 1, path, modified_ms + 1, pos FROM placed WHERE pos >= 150 AND pos < 350)
SELECT path, modified_ms, pos FROM pages QUALIFY row_number() OVER (PARTITION BY path ORDER BY page, pos) = 1""")
def _(spark, sf):
    placed = C.ordinal(clips(spark, sf).select("path", "modified_ms"), C.newest_first())
    shown = placed.where("pos < 200")
    arriving = placed.where("pos >= 150 AND pos < 350").withColumn("modified_ms", F.col("modified_ms") + 1)
    return C.append_pages(shown, arriving).select("path", "modified_ms", "pos")


@query("u8_next_offset", f"""WITH {SQL_CLIPS} SELECT least(count(*), 100) + 100 AS next_offset FROM clips""")
def _(spark, sf):
    return C.next_offset(C.page(clips(spark, sf).select("path", "modified_ms"), 0, 100), 100)


@query("w21_neighbours", f"""WITH {SQL_CLIPS}
SELECT path, row_number() OVER w - 1 AS pos, lag(path) OVER w AS prev_path, lead(path) OVER w AS next_path
FROM clips WINDOW w AS (ORDER BY modified_ms DESC, path)""")
def _(spark, sf):
    return C.clip_neighbours(clips(spark, sf).select("path", "modified_ms"), C.newest_first()).select(
        "path", "pos", "prev_path", "next_path")


@query("j1_overlay_metadata", f"""WITH {SQL_META}
SELECT c.clip_no, c.path, c.detected, coalesce(m.game, c.detected) AS source, m.cover, coalesce(m.cover_ms, 0) AS cover_ms,
  m.derived_from IS NOT NULL AS exported
FROM fx_clips c LEFT JOIN meta m ON c.clip_no = m.clip_no""")
def _(spark, sf):
    return C.overlay(view(spark, sf, "fx_clips"), meta(spark, sf), "clip_no").select(
        "clip_no", "path", "detected", "source", "cover", "cover_ms", "exported")


@query("j2_mark_edited", f"""WITH {SQL_EDITED}
SELECT c.clip_no, c.path, e.clip IS NOT NULL AS edited FROM fx_clips c LEFT JOIN edited e ON c.clip_no = e.clip""")
def _(spark, sf):
    done = edited_keys(view(spark, sf, "fx_edits"), view(spark, sf, "fx_segments")).withColumnRenamed("clip", "clip_no")
    return C.mark_edited(view(spark, sf, "fx_clips"), done, "clip_no").select("clip_no", "path", "edited")


@query("f1_text_search", f"""WITH {SQL_LIBRARY}
SELECT clip_no, title, source FROM library WHERE contains(lower(title), 'screen 2') OR contains(lower(source), 'screen 2')
  OR contains(lower(regexp_replace(source, '^[Pp]antalla ([0-9]+)$', 'Screen \\1')), 'screen 2')""")
def _(spark, sf):
    return C.search(library(spark, sf), " Screen 2 ").select("clip_no", "title", "source")


@query("f1_text_search_title", f"""WITH {SQL_LIBRARY}
SELECT clip_no, title, source FROM library WHERE contains(lower(title), 'widget') OR contains(lower(source), 'widget')""")
def _(spark, sf):
    return C.search(library(spark, sf), "WIDGET").select("clip_no", "title", "source")


@query("f2_facet_filter", f"""WITH {SQL_LIBRARY}
SELECT clip_no, source, edited, exported FROM library WHERE edited OR exported OR source IN ('ECONOMY', 'Pantalla 1')""")
def _(spark, sf):
    return C.facet_filter(library(spark, sf), True, ["ECONOMY", "Pantalla 1"]).select("clip_no", "source", "edited", "exported")


@query("a2_facet_values", f"""WITH {SQL_LIBRARY}
SELECT DISTINCT CASE WHEN regexp_matches(source, '(?i)^(pantalla|screen)\\b') THEN 'screen' ELSE 'game' END AS kind, source AS value
FROM library WHERE source <> ''
UNION ALL SELECT DISTINCT 'edited', '' FROM library WHERE edited OR exported""")
def _(spark, sf):
    return C.facets(library(spark, sf))


@query("a6_latest_cover", f"""WITH {SQL_LIBRARY}
SELECT source, cover FROM library WHERE cover IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source ORDER BY modified_ms DESC, path) = 1""")
def _(spark, sf):
    return C.group_cover(library(spark, sf))


@query("p1_effective_label", """SELECT c.clip_no, coalesce(trim(o.game), c.detected) AS label, c.detected
FROM fx_clips c LEFT JOIN fx_overlay o ON c.clip_no = o.clip_no""")
def _(spark, sf):
    c, o = view(spark, sf, "fx_clips"), view(spark, sf, "fx_overlay").select("clip_no", "game")
    return c.join(o, "clip_no", "left").select(
        "clip_no", text.effective_label(text.strip(F.col("game")), F.col("detected")).alias("label"), "detected")


@query("p2_override_of", """WITH choices AS (
  SELECT clip_no, detected, CASE clip_no % 4 WHEN 0 THEN concat(' ', upper(detected), ' ') WHEN 1 THEN '  ' WHEN 2 THEN title ELSE NULL END AS chosen FROM fx_clips)
SELECT clip_no, CASE WHEN trim(chosen) <> '' AND lower(trim(chosen)) <> lower(trim(detected)) THEN trim(chosen) END AS override FROM choices""")
def _(spark, sf):
    c = view(spark, sf, "fx_clips")
    chosen = F.expr("CASE clip_no % 4 WHEN 0 THEN concat(' ', upper(detected), ' ') WHEN 1 THEN '  ' WHEN 2 THEN title ELSE NULL END")
    return c.select("clip_no", text.override_of(chosen, F.col("detected")).alias("override"))


@query("p3_names", """SELECT r.idx, lower(regexp_extract(c.path, '\\.([^./]*)$', 1)) AS ext, regexp_extract(c.path, '([^/]+)\\.[^./]*$', 1) AS stem,
  lower(trim(regexp_extract(regexp_replace(r.exe, '^>+', ''), '([^/\\\\]*)$', 1))) AS exe
FROM fx_registry r JOIN fx_clips c ON r.idx = c.clip_no""")
def _(spark, sf):
    r = view(spark, sf, "fx_registry").select("idx", F.col("exe").alias("raw"))
    c = view(spark, sf, "fx_clips").select(F.col("clip_no").alias("idx"), "path")
    return r.join(c, "idx").select(
        "idx", text.file_ext(F.col("path")).alias("ext"), text.file_stem(F.col("path")).alias("stem"), text.exe_basename(F.col("raw")).alias("exe"))


@query("p4_is_screen_source", """SELECT clip_no, regexp_matches(trim(detected), '(?i)^(pantalla|screen)\\b') AS screen FROM fx_clips""")
def _(spark, sf):
    return view(spark, sf, "fx_clips").select("clip_no", text.is_screen(F.col("detected")).alias("screen"))


@query("p5_localize_label", """SELECT clip_no, concat(regexp_replace(detected, '^Pantalla ([0-9]+)$', 'Screen \\1'), ' · ', title, ' · ', 'Screen 7') AS label FROM fx_clips""")
def _(spark, sf):
    joined = F.concat("detected", F.lit(" · "), "title", F.lit(" · PANTALLA  7"))
    return view(spark, sf, "fx_clips").select("clip_no", text.localize_label(joined, "Screen").alias("label"))


@query("p6_slug", """SELECT idx, trim(regexp_replace(lower(concat('-', name, '™ ', cast(idx AS string), '!')), '[^a-z0-9]', '-', 'g'), '-') AS slug FROM fx_names""")
def _(spark, sf):
    return view(spark, sf, "fx_names").select("idx", text.slug(F.concat(F.lit("-"), "name", F.lit("™ "), F.col("idx").cast("string"), F.lit("!"))).alias("slug"))


@query("p7_initial", """SELECT idx, CASE WHEN idx % 9 = 0 THEN '?' WHEN idx % 9 = 1 THEN '7' ELSE upper(substr(name, 1, 1)) END AS initial FROM fx_names""")
def _(spark, sf):
    name = F.expr("CASE WHEN idx % 9 = 0 THEN '***' WHEN idx % 9 = 1 THEN concat('«7', name) ELSE concat('«', name) END")
    return view(spark, sf, "fx_names").select("idx", text.initial(name).alias("initial"))


@query("p8_badge_kind", f"""WITH {SQL_META}
SELECT c.clip_no, CASE WHEN m.cover IS NOT NULL THEN 'cover' WHEN c.detected = '' THEN 'imported'
  WHEN c.detected LIKE 'Pantalla %' THEN 'screen' WHEN r.icon_hash IS NOT NULL THEN 'game' ELSE 'initial' END AS badge
FROM fx_clips c LEFT JOIN meta m ON c.clip_no = m.clip_no LEFT JOIN fx_registry r ON r.idx = c.clip_no""")
def _(spark, sf):
    r = view(spark, sf, "fx_registry").select(F.col("idx").alias("clip_no"), "icon_hash")
    c = view(spark, sf, "fx_clips").join(meta(spark, sf), "clip_no", "left").join(r, "clip_no", "left")
    return c.select("clip_no", text.badge_kind(F.col("detected"), F.col("cover"), F.col("icon_hash")).alias("badge"))


@query("p9_format_duration", """WITH d AS (SELECT clip_no, duration_sec * 97 AS sec, cast(trunc(duration_sec * 1013) AS bigint) AS ms,
    duration_sec * 250 - 5000 AS code_ms FROM fx_clips)
SELECT clip_no, concat(printf('%02d', cast(floor(sec / 60) AS bigint)), ':', printf('%02d', cast(floor(sec % 60) AS bigint))) AS duration,
  concat(printf('%02d', ms // 60000), ':', printf('%02d', (ms // 1000) % 60), '.', printf('%03d', ms % 1000)) AS duration_ms,
  concat(printf('%02d', cast(floor(greatest(code_ms, 0) / 60000) AS bigint)), ':', printf('%02d', cast(floor(greatest(code_ms, 0) / 1000) AS bigint) % 60),
    '.', printf('%02d', cast(floor(greatest(code_ms, 0) / 10) AS bigint) % 100)) AS timecode
FROM d""")
def _(spark, sf):
    d = F.col("duration_sec")
    return view(spark, sf, "fx_clips").select(
        "clip_no", text.format_duration(d * 97).alias("duration"),
        text.format_duration_ms((d * 1013).cast("bigint")).alias("duration_ms"), text.format_timecode(d * 250 - 5000).alias("timecode"))


@query("p10_format_size", """WITH s AS (SELECT clip_no, size_bytes * (clip_no % 200 + 1) / 1048576.0 AS mb FROM fx_clips)
SELECT clip_no, CASE WHEN mb >= 1000 THEN printf('%.1f GB', round(cast(mb AS double) / 1024, 1)) ELSE printf('%.1f MB', round(cast(mb AS double), 1)) END AS size FROM s""")
def _(spark, sf):
    return view(spark, sf, "fx_clips").select("clip_no", text.format_size(F.col("size_bytes") * (F.col("clip_no") % 200 + 1)).alias("size"))


@query("p11_relative_age", f"""WITH t AS (SELECT clip_no, modified_ms - (clip_no % 900) * (clip_no % 700) * 100000 AS ts FROM fx_clips),
m AS (SELECT clip_no, cast(floor(({NOW} - ts) / 60000 + 0.5) AS bigint) AS mi, cast(floor(({NOW} - ts) / 1000) AS bigint) AS sec FROM t),
h AS (SELECT *, cast(floor(mi / 60 + 0.5) AS bigint) AS h, sec // 86400 AS day FROM m), d AS (SELECT *, cast(floor(h / 24 + 0.5) AS bigint) AS d FROM h)
SELECT clip_no, CASE WHEN mi < 1 THEN 'now' WHEN mi < 60 THEN 'min' WHEN h < 24 THEN 'h' WHEN d = 1 THEN 'yesterday' ELSE 'days' END AS unit,
  cast(CASE WHEN mi < 1 THEN 0 WHEN mi < 60 THEN mi WHEN h < 24 THEN h ELSE d END AS bigint) AS n,
  CASE WHEN sec < 60 THEN 'moment' WHEN sec < 3600 THEN 'min' WHEN sec < 86400 THEN 'h' WHEN day = 1 THEN 'yesterday' WHEN day < 7 THEN 'days'
    WHEN day < 30 THEN 'weeks' WHEN day < 365 THEN 'months' ELSE 'years' END AS floor_unit,
  cast(CASE WHEN sec < 60 THEN 0 WHEN sec < 3600 THEN sec // 60 WHEN sec < 86400 THEN sec // 3600 WHEN day < 7 THEN day
    WHEN day < 30 THEN day // 7 WHEN day < 365 THEN day // 30 ELSE day // 365 END AS bigint) AS floor_n FROM d""")
def _(spark, sf):
    ts = F.expr("modified_ms - (clip_no % 900) * (clip_no % 700) * 100000")
    a, b = text.age_bucket(ts, NOW), text.age_bucket(ts, NOW, "floored")
    return view(spark, sf, "fx_clips").select(
        "clip_no", a["unit"].alias("unit"), a["n"].alias("n"), b["unit"].alias("floor_unit"), b["n"].alias("floor_n"))


@query("p12_validate_name", """WITH req AS (SELECT path, CASE clip_no % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'a/b' WHEN 2 THEN concat(' ', regexp_extract(path, '([^/]+)\\.[^./]*$', 1))
    WHEN 3 THEN concat(replace(title, ' ', '_'), '_', cast(clip_no - 6 AS string)) WHEN 4 THEN 'x|y' ELSE 'fresh' END AS new_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
    regexp_extract(path, '\\.([^.]*)$', 1) AS ext FROM fx_clips)
SELECT r.path, r.new_name, CASE WHEN trim(new_name) = '' THEN 'empty' WHEN regexp_matches(new_name, '[/\\\\:*?"<>|]') THEN 'chars'
  WHEN concat(dir, '/', trim(new_name), '.', ext) = r.path THEN 'ok' WHEN c.path IS NOT NULL THEN 'exists' ELSE 'ok' END AS code
FROM req r LEFT JOIN fx_clips c ON c.path = concat(dir, '/', trim(new_name), '.', ext)""")
def _(spark, sf):
    c = view(spark, sf, "fx_clips")
    new = F.expr(r"""CASE clip_no % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'a/b' WHEN 2 THEN concat(' ', regexp_extract(path, '([^/]+)\\.[^./]*$', 1))
        WHEN 3 THEN concat(replace(title, ' ', '_'), '_', cast(clip_no - 6 AS string)) WHEN 4 THEN 'x|y' ELSE 'fresh' END""")
    return C.validate_renames(c.select("path", new.alias("new_name")), c).select("path", "new_name", "code")


@query("p13_free_name", """WITH req AS (SELECT clip_no AS req_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, replace(title, ' ', '_') AS stem FROM fx_clips),
taken AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]+)_[0-9]+\\.[^./]*$', 1) AS stem,
  cast(regexp_extract(path, '_([0-9]+)\\.[^./]*$', 1) AS bigint) AS n FROM fx_clips WHERE lower(path) LIKE '%.mp4'),
asked AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY req_id) AS k FROM req),
free AS (SELECT g.dir, g.stem, r.n, row_number() OVER (PARTITION BY g.dir, g.stem ORDER BY r.n) AS k
  FROM (SELECT DISTINCT dir, stem FROM req) g, (SELECT unnest(range(1, 1000)) AS n) r
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.dir = g.dir AND t.stem = g.stem AND t.n = r.n AND t.n >= 2))
SELECT req_id, a.dir, a.stem, CASE WHEN f.n >= 2 THEN concat(a.stem, '_', cast(f.n AS string)) ELSE a.stem END AS name
FROM asked a LEFT JOIN free f ON a.dir = f.dir AND a.stem = f.stem AND a.k = f.k""")
def _(spark, sf):
    c = view(spark, sf, "fx_clips")
    asks = c.select(F.col("clip_no").alias("req_id"), text.folder(F.col("path")).alias("dir"), F.replace(F.col("title"), F.lit(" "), F.lit("_")).alias("stem"))
    return C.assign_free_names(asks, c)


@query("j29_source_fallback", """WITH tags AS (SELECT path, concat('tag ', detected) AS source FROM fx_clips WHERE clip_no % 3 <> 0),
side AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS stem, concat('side ', detected) AS source FROM fx_clips WHERE clip_no % 5 <> 0)
SELECT c.clip_no, coalesce(CASE WHEN regexp_matches(lower(c.path), '\\.(mkv|webm)$') THEN NULL ELSE t.source END, s.source, '') AS detected
FROM fx_clips c LEFT JOIN tags t ON c.path = t.path
LEFT JOIN side s ON s.dir = regexp_extract(c.path, '^(.*)/[^/]*$', 1) AND s.stem = regexp_extract(c.path, '([^/]+)\\.[^./]*$', 1)""")
def _(spark, sf):
    c = view(spark, sf, "fx_clips")
    tags = c.where("clip_no % 3 <> 0").select("path", F.concat(F.lit("tag "), "detected").alias("source"))
    side = c.where("clip_no % 5 <> 0").select(
        text.folder(F.col("path")).alias("dir"), text.file_stem(F.col("path")).alias("stem"), F.concat(F.lit("side "), "detected").alias("source"))
    return C.detected_source(c, tags, side).select("clip_no", "detected")


@query("p32_source_tag", """WITH t AS (SELECT clip_no, title, CASE clip_no % 5 WHEN 0 THEN 'window' WHEN 1 THEN concat('\\\\.\\DISPLAY', cast(clip_no AS string)) WHEN 2 THEN 'DISPLAYx' WHEN 3 THEN 'monitor' ELSE NULL END AS target FROM fx_clips)
SELECT clip_no, CASE WHEN target IS NULL THEN '' WHEN target = 'window' THEN title WHEN regexp_matches(target, 'DISPLAY[0-9]+$')
  THEN concat('Pantalla ', regexp_extract(target, 'DISPLAY([0-9]+)$', 1)) ELSE 'Pantalla' END AS tag FROM t""")
def _(spark, sf):
    target = F.expr(r"CASE clip_no % 5 WHEN 0 THEN 'window' WHEN 1 THEN concat('\\\\.\\DISPLAY', cast(clip_no AS string)) WHEN 2 THEN 'DISPLAYx' WHEN 3 THEN 'monitor' ELSE NULL END")
    return view(spark, sf, "fx_clips").select("clip_no", text.source_label(target, F.col("title")).alias("tag"))
