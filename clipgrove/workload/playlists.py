"""Queries over playlists, entries and the keyed indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import view
from clipgrove.functions import text
from clipgrove.operators import indexes as X, playlists as P
from clipgrove.operators.catalog import ordinal, overlay
from clipgrove.operators.segments import with_noop
from clipgrove.session import cut
from clipgrove.workload import query
from clipgrove.workload.catalog import SQL_EDITED, SQL_META, meta

NOW = 1000000000000
KEY = "clip_no"


def entries(spark, sf):
    return view(spark, sf, "fx_playlist")


def clips(spark, sf):
    return view(spark, sf, "fx_clips")


def sourced(spark, sf):
    c = overlay(clips(spark, sf).select(KEY, "detected"), meta(spark, sf), KEY).select(KEY, "source")
    return P.resolve(entries(spark, sf), c, KEY)


SQL_SOURCED = f"""{SQL_META}, sourced AS (SELECT e.playlist_id, e.idx, coalesce(m.game, c.detected) AS source
  FROM fx_playlist e JOIN fx_clips c ON e.clip_no = c.clip_no LEFT JOIN meta m ON m.clip_no = c.clip_no)"""
SQL_HIST = f"""{SQL_SOURCED}, hist AS (
  SELECT playlist_id, source, count(*) AS n, false AS screen FROM sourced WHERE source <> '' AND source NOT LIKE 'Pantalla %' GROUP BY 1, 2
  UNION ALL SELECT playlist_id, string_agg(DISTINCT source, ' · ' ORDER BY source), count(*), true FROM sourced WHERE source LIKE 'Pantalla %' GROUP BY 1)"""


@query("j3_resolve_playlist", """SELECT e.playlist_id, e.idx, e.clip_no, c.path, c.title FROM fx_playlist e JOIN fx_clips c ON e.clip_no = c.clip_no""")
def _(spark, sf):
    return P.resolve(entries(spark, sf), clips(spark, sf).select(KEY, "path", "title"), KEY).select("playlist_id", "idx", KEY, "path", "title")


@query("j4_dangling", """SELECT playlist_id, idx, clip_no FROM fx_playlist WHERE clip_no NOT IN (SELECT clip_no FROM fx_clips)""")
def _(spark, sf):
    return P.dangling(entries(spark, sf), clips(spark, sf), KEY).select("playlist_id", "idx", KEY)


SQL_SEL = """sel AS (SELECT clip_no, CASE WHEN clip_no % 3 = 0 THEN clip_no ELSE clip_no - clip_no % 3 + 1 END AS selection_id FROM fx_clips),
n AS (SELECT selection_id, playlist_id, count(DISTINCT e.clip_no) AS n FROM sel JOIN fx_playlist e ON sel.clip_no = e.clip_no GROUP BY 1, 2),
t AS (SELECT selection_id, count(*) AS total FROM sel GROUP BY 1)"""


def selections(spark, sf):
    return clips(spark, sf).select(KEY, F.expr("CASE WHEN clip_no % 3 = 0 THEN clip_no ELSE clip_no - clip_no % 3 + 1 END AS selection_id"))


@query("j5_membership", f"""WITH {SQL_SEL} SELECT n.selection_id, playlist_id, CASE WHEN n = total THEN 'in' ELSE 'partial' END AS state FROM n JOIN t ON n.selection_id = t.selection_id""")
def _(spark, sf):
    return P.membership(selections(spark, sf), entries(spark, sf), key=KEY)


@query("j5_membership_asked", f"""WITH {SQL_SEL}, p AS (SELECT l_partkey - l_partkey % 3 AS selection_id, (l_orderkey + l_linenumber % 2) AS playlist_id FROM lineitem GROUP BY 1, 2)
SELECT p.selection_id, p.playlist_id, CASE WHEN n IS NULL THEN 'out' WHEN n = total THEN 'in' ELSE 'partial' END AS state
FROM p LEFT JOIN n ON p.selection_id = n.selection_id AND p.playlist_id = n.playlist_id LEFT JOIN t ON p.selection_id = t.selection_id""")
def _(spark, sf):
    from clipgrove.fixtures import table

    pairs = table(spark, sf, "lineitem").select(
        F.expr("l_partkey - l_partkey % 3 AS selection_id"), F.expr("l_orderkey + l_linenumber % 2 AS playlist_id")).distinct()
    return P.membership(selections(spark, sf), entries(spark, sf), pairs, KEY)


SQL_MAP = """mapping AS (SELECT clip_no AS old, clip_no + CASE WHEN clip_no % 14 = 0 THEN 10 ELSE 5000000 END AS new FROM fx_clips WHERE clip_no % 7 = 0)"""


def mapping(spark, sf):
    return clips(spark, sf).where("clip_no % 7 = 0").select(
        F.col(KEY).alias("old"), F.expr("clip_no + CASE WHEN clip_no % 14 = 0 THEN 10 ELSE 5000000 END AS new"))


def edits(spark, sf):
    return view(spark, sf, "fx_edits").withColumnRenamed("clip", KEY)


def rekeyed(spark, sf):
    return X.rekey(edits(spark, sf), meta(spark, sf), entries(spark, sf), mapping(spark, sf), KEY)


@query("j6_rekey_cascade_edits", f"""WITH {SQL_MAP}, moved AS (SELECT m.new AS clip_no, format_kind, brightness FROM fx_edits e JOIN mapping m ON e.clip = m.old)
SELECT * FROM moved UNION ALL SELECT clip, format_kind, brightness FROM fx_edits
WHERE clip NOT IN (SELECT old FROM mapping) AND clip NOT IN (SELECT clip_no FROM moved)""")
def _(spark, sf):
    return rekeyed(spark, sf)["edits"].select(KEY, "format_kind", "brightness")


@query("j6_rekey_cascade_overlay", f"""WITH {SQL_META}, {SQL_MAP}, moved AS (SELECT m.new AS clip_no, game, cover, derived_from FROM meta e JOIN mapping m ON e.clip_no = m.old),
a AS (SELECT * FROM moved UNION ALL SELECT clip_no, game, cover, derived_from FROM meta
  WHERE clip_no NOT IN (SELECT old FROM mapping) AND clip_no NOT IN (SELECT clip_no FROM moved))
SELECT clip_no, game, cover, coalesce(m.new, derived_from) AS derived_from FROM a LEFT JOIN mapping m ON a.derived_from = m.old""")
def _(spark, sf):
    return rekeyed(spark, sf)["meta"].select(KEY, "game", "cover", "derived_from")


@query("j6_rekey_cascade_entries", f"""WITH {SQL_MAP} SELECT playlist_id, idx, coalesce(m.new, clip_no) AS clip_no, added_ms FROM fx_playlist e LEFT JOIN mapping m ON e.clip_no = m.old""")
def _(spark, sf):
    return rekeyed(spark, sf)["entries"].select("playlist_id", "idx", KEY, "added_ms")


def forgotten(spark, sf):
    return X.forget(edits(spark, sf), meta(spark, sf), entries(spark, sf), clips(spark, sf).where("clip_no % 5 = 0").select(KEY), KEY)


@query("j7_forget_cascade_entries", """SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY idx) - 1 AS idx, clip_no, added_ms, seen
FROM fx_playlist WHERE clip_no NOT IN (SELECT clip_no FROM fx_clips WHERE clip_no % 5 = 0)""")
def _(spark, sf):
    return forgotten(spark, sf)["entries"]


@query("j7_forget_cascade_indexes", """WITH gone AS (SELECT clip_no FROM fx_clips WHERE clip_no % 5 = 0)
SELECT 'edit' AS kind, clip AS clip_no FROM fx_edits WHERE clip NOT IN (SELECT clip_no FROM gone)
UNION ALL SELECT 'overlay', clip_no FROM fx_overlay WHERE clip_no NOT IN (SELECT clip_no FROM gone)""")
def _(spark, sf):
    f = forgotten(spark, sf)
    return f["edits"].select(F.lit("edit").alias("kind"), KEY).unionByName(f["meta"].select(F.lit("overlay").alias("kind"), KEY))


@query("j7_forget_sidecars", """WITH files AS (SELECT path FROM fx_clips UNION ALL SELECT regexp_replace(path, '\\.[^.]*$', '.clip.json') FROM fx_clips WHERE clip_no % 2 = 0
  UNION ALL SELECT regexp_replace(path, '\\.[^.]*$', '.edit.json') FROM fx_clips WHERE clip_no % 3 = 0),
gone AS (SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS base FROM fx_clips WHERE clip_no % 5 = 0)
SELECT path FROM files WHERE path NOT IN (SELECT path FROM gone UNION ALL SELECT concat(base, '.clip.json') FROM gone UNION ALL SELECT concat(base, '.edit.json') FROM gone)""")
def _(spark, sf):
    c = clips(spark, sf)
    base = F.regexp_replace("path", r"\.[^.]*$", "")
    files = c.select("path").unionByName(c.where("clip_no % 2 = 0").select(F.concat(base, F.lit(".clip.json")).alias("path"))).unionByName(
        c.where("clip_no % 3 = 0").select(F.concat(base, F.lit(".edit.json")).alias("path")))
    return X.forget_files(files, c.where("clip_no % 5 = 0").select("path"))


@query("j8_inherit_lineage", f"""WITH {SQL_META}, ex AS (SELECT clip_no * 5 + 5 AS child, clip_no * 5 AS parent FROM fx_clips),
n AS (SELECT ex.child, ex.parent, m.game, m.cover, m.clip_no IS NOT NULL AS has FROM ex LEFT JOIN meta m ON m.clip_no = ex.parent)
SELECT coalesce(m.clip_no, n.child) AS clip_no, CASE WHEN n.has THEN n.game ELSE m.game END AS game, coalesce(n.cover, m.cover) AS cover,
  CASE WHEN n.cover IS NOT NULL THEN {NOW} ELSE coalesce(m.cover_ms, 0) END AS cover_ms, coalesce(n.parent, m.derived_from) AS derived_from
FROM meta m FULL JOIN n ON m.clip_no = n.child
WHERE coalesce(CASE WHEN n.has THEN n.game ELSE m.game END, n.cover, m.cover) IS NOT NULL OR n.parent IS NOT NULL OR m.derived_from IS NOT NULL""")
def _(spark, sf):
    exports = clips(spark, sf).select((F.col(KEY) * 5 + 5).alias("child"), (F.col(KEY) * 5).alias("parent"))
    return X.inherit(meta(spark, sf), exports, NOW, KEY)


@query("j31_playlists_of_clip", "SELECT DISTINCT clip_no, playlist_id FROM fx_playlist")
def _(spark, sf):
    return P.playlists_of(entries(spark, sf), KEY)


@query("a3_source_histogram", f"WITH {SQL_HIST} SELECT * FROM hist")
def _(spark, sf):
    return P.source_histogram(sourced(spark, sf))


@query("a4_total_duration", """SELECT playlist_id, sum(duration_sec) AS total_sec, count(*) AS clips FROM fx_playlist e JOIN fx_clips c ON e.clip_no = c.clip_no GROUP BY 1""")
def _(spark, sf):
    return P.totals(entries(spark, sf), clips(spark, sf), KEY)


@query("t5_top_slots", f"""WITH {SQL_HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, source) AS slot FROM hist),
h AS (SELECT playlist_id, string_agg(source, ' · ' ORDER BY slot) AS hidden, count(*) AS rest FROM r WHERE slot >= 4 GROUP BY 1)
SELECT r.playlist_id, slot, source, n, screen, CASE WHEN rest > 1 THEN rest ELSE 0 END AS overflow, coalesce(hidden, '') AS hidden
FROM r LEFT JOIN h ON r.playlist_id = h.playlist_id WHERE slot <= 4""")
def _(spark, sf):
    return P.top_slots(P.source_histogram(sourced(spark, sf)))


@query("f5_fresh_entries", """SELECT playlist_id, idx, clip_no FROM fx_playlist WHERE NOT seen AND added_ms > 0 AND 900000000000 - added_ms < 604800000""")
def _(spark, sf):
    return P.fresh(entries(spark, sf), 900000000000).select("playlist_id", "idx", KEY)


@query("t2_sort_modes", """WITH e AS (SELECT playlist_id, idx, added_ms, modified_ms FROM fx_playlist e JOIN fx_clips c ON e.clip_no = c.clip_no)
SELECT playlist_id, idx, row_number() OVER (PARTITION BY playlist_id ORDER BY modified_ms DESC, idx) - 1 AS newest,
  row_number() OVER (PARTITION BY playlist_id ORDER BY modified_ms, idx) - 1 AS oldest,
  row_number() OVER (PARTITION BY playlist_id ORDER BY added_ms DESC, idx DESC) - 1 AS added,
  row_number() OVER (PARTITION BY playlist_id ORDER BY idx) - 1 AS custom FROM e""")
def _(spark, sf):
    e = P.resolve(entries(spark, sf), clips(spark, sf).select(KEY, "modified_ms"), KEY).select("playlist_id", "idx", "added_ms", "modified_ms")
    e = cut(e)
    for mode in ("newest", "oldest", "added", "custom"):
        e = P.sort_positions(e, mode, mode)
    return e.select("playlist_id", "idx", "newest", "oldest", "added", "custom")


@query("t3_playlist_order", """SELECT playlist_id, row_number() OVER (ORDER BY pos IS NOT NULL, CASE WHEN pos IS NULL THEN -created_ms END, pos, playlist_id) - 1 AS place FROM fx_playlists""")
def _(spark, sf):
    return ordinal(view(spark, sf, "fx_playlists"), P.order_playlists(), "place").select("playlist_id", "place")


SQL_ADDS = """adds AS (SELECT o_orderkey AS playlist_id, o_custkey * 10 + k AS place, (o_custkey * 7 + k * (o_orderkey % 3)) % 250 AS clip_no
  FROM orders, (SELECT unnest(range(5)) AS k) WHERE o_orderkey % 2 = 0)"""


def adds(spark, sf):
    from clipgrove.fixtures import table

    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return o.select(F.col("o_orderkey").alias("playlist_id"), (F.col("o_custkey") * 10 + F.col("k")).alias("place"),
                    F.expr("(o_custkey * 7 + k * (o_orderkey % 3)) % 250 AS clip_no"))


@query("u2_add_entries", f"""WITH {SQL_ADDS}, new AS (SELECT playlist_id, clip_no, min(place) AS place FROM adds a
  WHERE NOT EXISTS (SELECT 1 FROM fx_playlist e WHERE e.playlist_id = a.playlist_id AND e.clip_no = a.clip_no) GROUP BY 1, 2),
n AS (SELECT playlist_id, count(*) AS n FROM fx_playlist GROUP BY 1)
SELECT playlist_id, idx, clip_no, added_ms, seen FROM fx_playlist
UNION ALL SELECT new.playlist_id, coalesce(n, 0) + row_number() OVER (PARTITION BY new.playlist_id ORDER BY place) - 1, clip_no, {NOW}, false FROM new LEFT JOIN n ON new.playlist_id = n.playlist_id""")
def _(spark, sf):
    return P.add_entries(entries(spark, sf), adds(spark, sf), NOW, view(spark, sf, "fx_playlists"), KEY)


@query("u3_remove_entries", f"""WITH {SQL_ADDS}
SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY idx) - 1 AS idx, clip_no, added_ms, seen
FROM fx_playlist e WHERE NOT (playlist_id % 2 = 0 AND clip_no % 3 = 0)""")
def _(spark, sf):
    e = entries(spark, sf)
    return P.remove_entries(e, e.where("playlist_id % 2 = 0 AND clip_no % 3 = 0").select("playlist_id", KEY), KEY)


@query("u4_restore_entries", """WITH RECURSIVE base AS (SELECT playlist_id, coalesce(list(clip_no ORDER BY idx) FILTER (WHERE clip_no % 3 <> 0), []) AS l FROM fx_playlist GROUP BY 1),
back AS (SELECT playlist_id, clip_no, row_number() OVER (PARTITION BY playlist_id ORDER BY old_idx) - 1 AS k, old_idx
  FROM (SELECT playlist_id, clip_no, min(idx * (1 + playlist_id % 2)) AS old_idx FROM fx_playlist WHERE clip_no % 3 = 0 GROUP BY 1, 2)),
f AS (SELECT playlist_id, l, 0 AS k FROM base UNION ALL
  SELECT f.playlist_id, list_concat(f.l[1:least(old_idx, len(f.l))], [clip_no], f.l[least(old_idx, len(f.l)) + 1:]), f.k + 1 FROM f JOIN back b ON b.playlist_id = f.playlist_id AND b.k = f.k),
last AS (SELECT playlist_id, arg_max(l, k) AS l FROM f GROUP BY 1)
SELECT playlist_id, unnest(range(len(l))) AS idx, unnest(l) AS clip_no FROM last""")
def _(spark, sf):
    """Undo of a removal, half of it with places beyond the end of the list."""
    e = entries(spark, sf)
    gone = e.where("clip_no % 3 = 0")
    left = P.remove_entries(e, gone.select("playlist_id", KEY), KEY)
    back = gone.withColumn("old_idx", F.expr("idx * (1 + playlist_id % 2)")).drop("idx")
    return P.restore_entries(left, back, KEY).select("playlist_id", "idx", KEY)


SQL_ORDER = """ord AS (SELECT playlist_id, max(idx) OVER (PARTITION BY playlist_id) - idx AS place, CASE WHEN idx % 4 = 3 THEN clip_no + 7 ELSE clip_no END AS clip_no
  FROM fx_playlist WHERE playlist_id % 3 = 0 AND idx % 5 <> 2)"""


def orders(spark, sf):
    e = entries(spark, sf).where("playlist_id % 3 = 0 AND idx % 5 <> 2")
    top = e.groupBy("playlist_id").agg(F.max("idx").alias("top"))
    return e.join(top, "playlist_id").select("playlist_id", (F.col("top") - F.col("idx")).alias("place"),
                                             F.expr("CASE WHEN idx % 4 = 3 THEN clip_no + 7 ELSE clip_no END AS clip_no"))


@query("u5_set_order", f"""WITH {SQL_ORDER}, known AS (SELECT * FROM fx_playlist QUALIFY row_number() OVER (PARTITION BY playlist_id, clip_no ORDER BY idx) = 1)
SELECT o.playlist_id, row_number() OVER (PARTITION BY o.playlist_id ORDER BY place) - 1 AS idx, o.clip_no, coalesce(k.added_ms, {NOW}) AS added_ms, coalesce(k.seen, false) AS seen
FROM ord o LEFT JOIN known k ON k.playlist_id = o.playlist_id AND k.clip_no = o.clip_no
UNION ALL SELECT playlist_id, idx, clip_no, added_ms, seen FROM fx_playlist WHERE playlist_id NOT IN (SELECT playlist_id FROM ord)""")
def _(spark, sf):
    return P.set_order(entries(spark, sf), orders(spark, sf), NOW, KEY)


@query("u6_reorder_visible", f"""WITH shown AS (SELECT e.playlist_id, -e.idx AS place, e.clip_no FROM fx_playlist e JOIN fx_clips c ON e.clip_no = c.clip_no),
a AS (SELECT playlist_id, clip_no, 0 AS side, place FROM shown UNION ALL SELECT playlist_id, clip_no, 1, idx FROM fx_playlist e
  WHERE playlist_id IN (SELECT playlist_id FROM shown) AND clip_no NOT IN (SELECT clip_no FROM fx_clips))
SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY side, place) - 1 AS place, clip_no FROM a""")
def _(spark, sf):
    e = entries(spark, sf)
    shown = P.resolve(e, clips(spark, sf).select(KEY), KEY).select("playlist_id", (-F.col("idx")).alias("place"), KEY)
    return P.reorder_visible(e, shown, KEY)


@query("u7_reorder_playlists", """SELECT p.playlist_id, p.name, p.created_ms, CASE WHEN p.playlist_id % 3 = 0 THEN (p.playlist_id * 31) % 1009 END AS pos FROM fx_playlists p""")
def _(spark, sf):
    p = view(spark, sf, "fx_playlists")
    ids = p.where("playlist_id % 3 = 0").select("playlist_id", F.expr("(playlist_id * 31) % 1009 AS place"))
    again = ids.withColumn("place", F.col("place") + 5000)
    return P.reorder_playlists(p, ids.unionByName(again))


@query("u9_mark_seen", """WITH hit AS (SELECT playlist_id, min(idx) AS idx FROM fx_playlist WHERE clip_no % 4 = 1 GROUP BY playlist_id, clip_no)
SELECT e.playlist_id, e.idx, e.clip_no, e.seen OR h.idx IS NOT NULL AS seen FROM fx_playlist e LEFT JOIN hit h ON h.playlist_id = e.playlist_id AND h.idx = e.idx""")
def _(spark, sf):
    e = entries(spark, sf)
    return P.mark_seen(e, e.where("clip_no % 4 = 1").select("playlist_id", KEY), KEY).select("playlist_id", "idx", KEY, "seen")


@query("f9_neutral_entry_prune", f"WITH {SQL_META} SELECT clip_no FROM meta WHERE game IS NOT NULL OR cover IS NOT NULL OR derived_from IS NOT NULL")
def _(spark, sf):
    return X.prune_empty(meta(spark, sf)).select(KEY)


@query("u11_apply_edits", f"""WITH {SQL_EDITED}, batch AS (SELECT c AS clip, seq, (c + seq) % 3 = 0 AS noop, format_kind FROM (
    SELECT clip - clip % 2 AS c, clip, clip % 2 AS seq, format_kind FROM fx_edits) b),
l AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY clip ORDER BY seq DESC) = 1)
SELECT e.clip, e.format_kind FROM fx_edits e WHERE e.clip IN (SELECT clip FROM edited) AND e.clip NOT IN (SELECT clip FROM l)
UNION ALL SELECT clip, format_kind FROM l WHERE NOT noop""")
def _(spark, sf):
    return X.apply_edits(*edit_batch(spark, sf), "clip")[0]


def edit_batch(spark, sf):
    e = view(spark, sf, "fx_edits")
    index = with_noop(e, view(spark, sf, "fx_segments")).where("NOT noop").select("clip", "format_kind")
    batch = e.select(F.expr("clip - clip % 2 AS clip"), F.expr("clip % 2 AS seq"), "format_kind").withColumn("noop", F.expr("(clip + seq) % 3 = 0"))
    return index, batch


@query("u11_apply_edits_flags", """SELECT clip - clip % 2 AS clip, NOT arg_max((clip - clip % 2 + clip % 2) % 3 = 0, clip % 2) AS edited FROM fx_edits GROUP BY 1""")
def _(spark, sf):
    return X.apply_edits(*edit_batch(spark, sf), "clip")[1]


SQL_OPS = """ops AS (SELECT c.clip_no - c.clip_no % 4 AS clip_no, c.clip_no % 4 AS seq, CASE c.clip_no % 5 WHEN 0 THEN 'set_cover' WHEN 1 THEN 'clear_cover' ELSE 'set_game' END AS op,
  CASE WHEN c.clip_no % 3 = 0 THEN '  ' ELSE concat(' ', c.title) END AS value, 17 + c.clip_no AS stamp FROM fx_clips c)"""


@query("u12_apply_overlay", f"""WITH {SQL_META}, {SQL_OPS}, g AS (SELECT * FROM ops WHERE op = 'set_game' QUALIFY row_number() OVER (PARTITION BY clip_no ORDER BY seq DESC) = 1),
c AS (SELECT * FROM ops WHERE op <> 'set_game' QUALIFY row_number() OVER (PARTITION BY clip_no ORDER BY seq DESC) = 1),
k AS (SELECT clip_no FROM meta UNION SELECT clip_no FROM ops),
r AS (SELECT k.clip_no, CASE WHEN g.clip_no IS NOT NULL THEN nullif(trim(g.value), '') ELSE m.game END AS game,
  CASE WHEN c.clip_no IS NULL THEN m.cover WHEN c.op = 'set_cover' THEN c.value END AS cover,
  coalesce(CASE WHEN c.clip_no IS NULL THEN m.cover_ms WHEN c.op = 'set_cover' THEN c.stamp END, 0) AS cover_ms, m.derived_from
  FROM k LEFT JOIN meta m ON m.clip_no = k.clip_no LEFT JOIN g ON g.clip_no = k.clip_no LEFT JOIN c ON c.clip_no = k.clip_no)
SELECT * FROM r WHERE game IS NOT NULL OR cover IS NOT NULL OR derived_from IS NOT NULL""")
def _(spark, sf):
    ops = clips(spark, sf).select(
        F.expr("clip_no - clip_no % 4 AS clip_no"), F.expr("clip_no % 4 AS seq"),
        F.expr("CASE clip_no % 5 WHEN 0 THEN 'set_cover' WHEN 1 THEN 'clear_cover' ELSE 'set_game' END AS op"),
        F.expr("CASE WHEN clip_no % 3 = 0 THEN '  ' ELSE concat(' ', title) END AS value"), F.expr("17 + clip_no AS stamp"))
    return X.apply_overlay(meta(spark, sf), ops, KEY)


def playlist_ops(spark, sf):
    p = view(spark, sf, "fx_playlists").withColumn("playlist_id", F.col("playlist_id").cast("string")).withColumn("description", F.lit(""))
    ops = p.select(
        F.col("created_ms").alias("_c"), F.col("playlist_id").cast("bigint").alias("seq"),
        F.expr("CASE seq % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS op"),
        F.expr("CAST(seq - seq % 3 AS string) AS playlist_id"),
        F.expr("CASE WHEN seq % 5 = 0 THEN '  ' ELSE concat(' new ', CAST(seq AS string)) END AS name"), F.lit(" d ").alias("description")).drop("_c")
    return P.apply_playlists(p, ops, NOW)


SQL_POPS = """ops AS (SELECT playlist_id AS seq, CASE playlist_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
  cast(playlist_id - playlist_id % 3 AS string) AS playlist_id, CASE WHEN playlist_id % 5 = 0 THEN '  ' ELSE concat(' new ', cast(playlist_id AS string)) END AS name FROM fx_playlists)"""


@query("u13_apply_playlists", f"""WITH {SQL_POPS}, u AS (SELECT playlist_id, trim(name) AS name FROM ops WHERE op = 'update' AND trim(name) <> ''
  QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY seq DESC) = 1)
SELECT cast(p.playlist_id AS string) AS playlist_id, coalesce(u.name, p.name) AS name, CASE WHEN u.name IS NOT NULL THEN 'd' ELSE '' END AS description, created_ms, pos
FROM fx_playlists p LEFT JOIN u ON u.playlist_id = cast(p.playlist_id AS string) WHERE cast(p.playlist_id AS string) NOT IN (SELECT playlist_id FROM ops WHERE op = 'delete')
UNION ALL SELECT concat('pl{NOW}', lower(to_hex(seq))), trim(name), 'd', {NOW}, NULL FROM ops WHERE op = 'create' AND trim(name) <> ''""")
def _(spark, sf):
    return playlist_ops(spark, sf)[0]


@query("u13_rejected", f"WITH {SQL_POPS} SELECT seq, op FROM ops WHERE op IN ('create', 'update') AND trim(name) = ''")
def _(spark, sf):
    return playlist_ops(spark, sf)[1].select("seq", "op")
