"""Queries over the game registry and process tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrove.fixtures import view
from clipgrove.operators import processes as Q, registry as R
from clipgrove.workload import query

URL = "https://icons.example/"

SQL_USABLE = """usable AS (SELECT idx, name, lower(regexp_extract(regexp_replace(exe, '^>+', ''), '([^/]*)$', 1)) AS base, icon_hash FROM fx_registry
  WHERE NOT is_launcher AND arguments IS NULL AND os IN ('', 'win32') AND lower(exe) LIKE '%.exe')"""
SQL_OWNERS = f"""{SQL_USABLE}, owners AS (SELECT base, min(name) AS name, arg_min(coalesce(icon_hash, '~'), idx) AS icon FROM usable GROUP BY base HAVING count(DISTINCT name) = 1)"""
SQL_PROCS = """procs AS (SELECT pid % 8 AS host, pid, parent, CASE WHEN pid % 3 = 0 THEN lower(concat(CASE pid % 2 WHEN 0 THEN 'economy_' ELSE 'promo_' END, cast(pid % 50 + 1 AS string), '.exe')) ELSE exe END AS exe, path FROM fx_procs)"""
SQL_MANIFESTS = """manifests AS (SELECT concat('c:/lib', cast(p_partkey % 25 AS string), '/steamapps') AS lib_root, concat('DIR', cast(p_partkey % 47 AS string)) AS installdir,
  concat(p_name, '™ ') AS name, CASE WHEN p_partkey % 10 = 3 THEN 'x' ELSE cast(p_partkey AS string) END AS appid, p_partkey AS file FROM part),
mf AS (SELECT * FROM manifests QUALIFY row_number() OVER (PARTITION BY lib_root, lower(installdir) ORDER BY file) = 1),
store AS (SELECT p.pid, trim(replace(m.name, '™', '')) AS game, cast(m.appid AS bigint) AS appid FROM fx_procs p JOIN mf m
  ON m.lib_root = concat(split_part(p.path, '/steamapps/', 1), '/steamapps') AND lower(m.installdir) = lower(regexp_extract(p.path, '/steamapps/common/([^/]+)', 1)) WHERE m.appid <> 'x')"""


def registry(spark, sf):
    return view(spark, sf, "fx_registry")


def owners(spark, sf):
    return R.exclusive_owner(R.usable_executables(registry(spark, sf).withColumnRenamed("icon_hash", "icon")))


def procs(spark, sf):
    return view(spark, sf, "fx_procs").select(F.expr("pid % 8 AS host"), "pid", "parent", F.expr(
        "CASE WHEN pid % 3 = 0 THEN concat(CASE pid % 2 WHEN 0 THEN 'economy_' ELSE 'promo_' END, cast(pid % 50 + 1 AS string), '.exe') ELSE exe END AS exe"), "path")


def manifests(spark, sf):
    from clipgrove.fixtures import table

    return table(spark, sf, "part").select(
        F.expr("concat('c:/lib', cast(p_partkey % 25 AS string), '/steamapps') AS lib_root"), F.expr("concat('DIR', cast(p_partkey % 47 AS string)) AS installdir"),
        F.expr("concat(p_name, '™ ') AS name"), F.expr("CASE WHEN p_partkey % 10 = 3 THEN 'x' ELSE cast(p_partkey AS string) END AS appid"), F.col("p_partkey").alias("file"))


@query("f4_executable_filter", f"WITH {SQL_USABLE} SELECT idx, name, base FROM usable")
def _(spark, sf):
    return R.usable_executables(registry(spark, sf)).select("idx", "name", "base")


@query("a5_exclusive_owner", f"WITH {SQL_OWNERS} SELECT base, name, nullif(icon, '~') AS icon FROM owners")
def _(spark, sf):
    return owners(spark, sf)


@query("j9_lookup_by_name", f"""WITH r AS (SELECT * FROM fx_registry QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY idx) = 1)
SELECT n.idx, n.name, CASE WHEN r.icon_hash IS NOT NULL AND r.idx % 5 <> 0 THEN concat('{URL}', cast(r.idx AS string), '/', r.icon_hash, '.png') END AS icon_url,
  CASE WHEN r.idx % 3 = 0 THEN r.idx END AS steam_appid
FROM (SELECT idx, concat(' ', upper(name), CASE WHEN idx % 7 = 0 THEN '!' ELSE ' ' END) AS name FROM fx_names) n LEFT JOIN r ON lower(trim(r.name)) = lower(trim(n.name))""")
def _(spark, sf):
    names = view(spark, sf, "fx_names").select("idx", F.expr("concat(' ', upper(name), CASE WHEN idx % 7 = 0 THEN '!' ELSE ' ' END) AS name"))
    r = registry(spark, sf).select("idx", "name", "icon_hash", F.expr("CASE WHEN idx % 5 <> 0 THEN cast(idx AS string) ELSE '' END AS id"),
                                   F.expr("CASE WHEN idx % 3 = 0 THEN idx END AS steam_appid"), F.lit(None).cast("string").alias("xbox_sku"))
    return R.registry_lookup(names, r, URL).select("idx", "name", "icon_url", "steam_appid")


@query("j10_lookup_by_executable", f"WITH {SQL_OWNERS}, {SQL_PROCS} SELECT pid, p.exe, o.name, nullif(icon, '~') AS icon FROM procs p JOIN owners o ON p.exe = o.base")
def _(spark, sf):
    return R.exe_lookup(procs(spark, sf), owners(spark, sf)).select("pid", "exe", "name", "icon")


@query("j12_install_dir_join", f"WITH {SQL_MANIFESTS} SELECT p.pid, s.game, s.appid FROM fx_procs p LEFT JOIN store s ON p.pid = s.pid")
def _(spark, sf):
    return R.manifest_join(view(spark, sf, "fx_procs"), manifests(spark, sf)).select("pid", "game", "appid")


SQL_DETECT = f"""{SQL_OWNERS}, {SQL_PROCS}, {SQL_MANIFESTS}, h AS (SELECT host, pid, contains(path, 'minecraft') AS hint FROM procs),
d AS (SELECT p.host, p.pid, coalesce(s.game, o.name, CASE WHEN p.exe = 'javaw.exe' AND EXISTS (SELECT 1 FROM h WHERE h.host = p.host AND h.hint) THEN 'Minecraft' END) AS game,
  CASE WHEN s.game IS NOT NULL THEN 'store' WHEN o.name IS NOT NULL THEN 'exe' WHEN p.exe = 'javaw.exe' AND EXISTS (SELECT 1 FROM h WHERE h.host = p.host AND h.hint) THEN 'hint' END AS how
  FROM procs p LEFT JOIN store s ON p.pid = s.pid LEFT JOIN owners o ON o.base = p.exe)"""


@query("j11_detection_cascade", f"WITH {SQL_DETECT} SELECT * FROM d")
def _(spark, sf):
    return R.detect(procs(spark, sf), owners(spark, sf), manifests(spark, sf), ["host"]).select("host", "pid", "game", "how")


@query("j11_keep_last", f"""WITH RECURSIVE {SQL_DETECT}, seen AS (SELECT stream_id AS session, seq, CASE WHEN seq % 3 = 0 THEN seq * 13 % (SELECT count(*) FROM fx_procs) + 1 END AS pid FROM fx_packets),
ended AS (SELECT session, pid, min(seq) + 25 + session AS end_seq FROM seen WHERE pid % 2 = 0 GROUP BY session, pid),
s AS (SELECT seen.session, seq, seen.pid, d.game, end_seq, row_number() OVER (PARTITION BY seen.session ORDER BY seq) AS r FROM seen LEFT JOIN d ON d.pid = seen.pid LEFT JOIN ended e ON e.pid = seen.pid AND e.session = seen.session),
f AS (SELECT session, seq, r, game AS current, end_seq FROM s WHERE r = 1
  UNION ALL SELECT s.session, s.seq, s.r, CASE WHEN s.game IS NOT NULL THEN s.game WHEN f.end_seq IS NULL OR f.end_seq > s.seq THEN f.current END,
    CASE WHEN s.game IS NOT NULL THEN s.end_seq ELSE f.end_seq END FROM f JOIN s ON s.session = f.session AND s.r = f.r + 1)
SELECT session, seq, current FROM f""")
def _(spark, sf):
    found = R.detect(procs(spark, sf), owners(spark, sf), manifests(spark, sf), ["host"]).select("pid", "game")
    n = view(spark, sf, "fx_procs").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    packets = view(spark, sf, "fx_packets").select(F.col("stream_id").alias("session"), "seq", F.lit(1).alias("one"))
    seen = packets.join(F.broadcast(n), "one").select("session", "seq", F.expr("CASE WHEN seq % 3 = 0 THEN seq * 13 % n + 1 END AS pid"))
    ends = seen.where("pid % 2 = 0").groupBy("session", "pid").agg(F.expr("min(seq) + 25 + session AS end_seq"))
    return R.keep_last(seen.join(found, "pid", "left").select("session", "seq", "pid", "game"), ends).select("session", "seq", "current")


SQL_RANK = """WITH n AS (SELECT idx, name, lower(trim(name)) AS l FROM fx_names QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY idx) = 1),
t AS (SELECT name, l, CASE WHEN l = '{q}' THEN 0 WHEN starts_with(l, '{q}') THEN 1 WHEN contains(concat(' ', l), ' {q}') THEN 2 WHEN contains(l, '{q}') THEN 3 END AS tier FROM n)
SELECT name, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, l LIMIT 12"""


@query("t4_ranked_search", SQL_RANK.replace("{q}", "re"))
def _(spark, sf):
    return R.rank_names(view(spark, sf, "fx_names"), " RE ")


@query("t4_ranked_search_word", SQL_RANK.replace("{q}", "ring"))
def _(spark, sf):
    return R.rank_names(view(spark, sf, "fx_names"), "ring")


@query("j28_pick_best_match", """WITH hits AS (SELECT idx // 5 * 5 AS query, idx, name, idx % 3 = 0 AS steam, idx % 2 = 0 AS typed FROM fx_names),
w AS (SELECT idx AS query, name AS wanted FROM fx_names), j AS (SELECT h.*, w.wanted, lower(h.name) = lower(w.wanted) AS exact FROM hits h JOIN w ON h.query = w.query),
e AS (SELECT query, idx, name FROM j WHERE exact QUALIFY row_number() OVER (PARTITION BY query ORDER BY steam DESC, typed DESC, idx DESC) = 1),
f AS (SELECT query, idx, name FROM j WHERE query NOT IN (SELECT query FROM e) QUALIFY row_number() OVER (PARTITION BY query ORDER BY idx) = 1)
SELECT * FROM e UNION ALL SELECT * FROM f""")
def _(spark, sf):
    n = view(spark, sf, "fx_names")
    wanted = n.select(F.col("idx").alias("query"), F.expr("name AS wanted"))
    hits = n.select(F.expr("idx div 5 * 5 AS query"), "idx", "name", F.expr("idx % 3 = 0 AS steam"), F.expr("idx % 2 = 0 AS has_types")).join(wanted, "query")
    return R.pick_game(hits).select("query", "idx", "name")


SQL_ROOTS = """RECURSIVE slots AS (SELECT * FROM (VALUES ('discord.exe', 0), ('game.exe', 2)) s(exe, slot)),
cand AS (SELECT p.pid, s.slot FROM fx_procs p JOIN slots s ON p.exe = s.exe LEFT JOIN fx_procs u ON u.pid = p.parent WHERE (u.pid IS NULL OR u.exe <> p.exe) AND p.pid <> 40
  UNION ALL SELECT pid, 1 FROM fx_procs WHERE pid = 40),
up AS (SELECT pid, parent AS anc FROM fx_procs WHERE parent <> 0 UNION ALL SELECT up.pid, p.parent FROM up JOIN fx_procs p ON p.pid = up.anc WHERE p.parent <> 0)
SELECT pid, slot FROM cand WHERE pid NOT IN (SELECT up.pid FROM up JOIN cand c ON c.pid = up.anc)"""


@query("j22_process_roots", f"WITH {SQL_ROOTS}")
def _(spark, sf):
    return Q.process_roots(view(spark, sf, "fx_procs"), ["discord.exe", None, "game.exe"], 40)


@query("j23_session_owner", """WITH RECURSIVE up AS (SELECT pid, pid AS anc FROM fx_procs UNION ALL SELECT up.pid, p.parent FROM up JOIN fx_procs p ON p.pid = up.anc WHERE p.parent <> 0),
own AS (SELECT pid, bool_or(anc = 7) AS mine FROM up GROUP BY pid),
web AS (SELECT pid, pid AS cur, 0 AS d FROM fx_procs UNION ALL SELECT w.pid, p.parent, d + 1 FROM web w JOIN fx_procs p ON p.pid = w.cur WHERE p.exe = 'msedgewebview2.exe'),
o AS (SELECT pid, arg_max(cur, d) AS owner FROM web GROUP BY pid)
SELECT o.pid, CASE WHEN NOT mine THEN owner END AS owner FROM o JOIN own ON own.pid = o.pid""")
def _(spark, sf):
    return Q.session_owner(view(spark, sf, "fx_procs"), 7)


SQL_HOSTS = """two AS (SELECT 0 AS host, pid, parent, exe FROM fx_procs UNION ALL SELECT 1, pid, (pid - 1) // 3, exe FROM fx_procs)"""


def two_hosts(spark, sf):
    """Equal pids on two machines, in different trees."""
    p = view(spark, sf, "fx_procs")
    return p.select(F.lit(0).alias("host"), "pid", "parent", "exe").unionByName(p.select(F.lit(1).alias("host"), "pid", F.expr("(pid - 1) div 3 AS parent"), "exe"))


def of_hosts(spark, first, second):
    return spark.sql(f"SELECT * FROM VALUES (0, {first}L), (1, {second}L) AS t(host, pid)")


@query("j22_process_roots_hosts", f"""WITH RECURSIVE {SQL_HOSTS}, slots AS (SELECT * FROM (VALUES ('discord.exe', 0), ('game.exe', 2)) s(exe, slot)),
cand AS (SELECT p.host, p.pid, s.slot FROM two p JOIN slots s ON p.exe = s.exe LEFT JOIN two u ON u.host = p.host AND u.pid = p.parent WHERE (u.pid IS NULL OR u.exe <> p.exe) AND p.pid <> 40 + p.host
  UNION ALL SELECT host, pid, 1 FROM two WHERE pid = 40 + host),
up AS (SELECT host, pid, parent AS anc FROM two WHERE parent <> 0 UNION ALL SELECT up.host, up.pid, p.parent FROM up JOIN two p ON p.host = up.host AND p.pid = up.anc WHERE p.parent <> 0)
SELECT host, pid, slot FROM cand WHERE (host, pid) NOT IN (SELECT (up.host, up.pid) FROM up JOIN cand c ON c.host = up.host AND c.pid = up.anc)""")
def _(spark, sf):
    return Q.process_roots(two_hosts(spark, sf), ["discord.exe", None, "game.exe"], of_hosts(spark, 40, 41), ["host"])


@query("j23_session_owner_hosts", f"""WITH RECURSIVE {SQL_HOSTS}, up AS (SELECT host, pid, pid AS anc FROM two UNION ALL SELECT up.host, up.pid, p.parent FROM up JOIN two p ON p.host = up.host AND p.pid = up.anc WHERE p.parent <> 0),
own AS (SELECT host, pid, bool_or(anc = 7 + host) AS mine FROM up GROUP BY host, pid),
web AS (SELECT host, pid, pid AS cur, 0 AS d FROM two UNION ALL SELECT w.host, w.pid, p.parent, d + 1 FROM web w JOIN two p ON p.host = w.host AND p.pid = w.cur WHERE p.exe = 'msedgewebview2.exe'),
o AS (SELECT host, pid, arg_max(cur, d) AS owner FROM web GROUP BY host, pid)
SELECT o.host, o.pid, CASE WHEN NOT mine THEN owner END AS owner FROM o JOIN own ON own.pid = o.pid AND own.host = o.host""")
def _(spark, sf):
    return Q.session_owner(two_hosts(spark, sf), of_hosts(spark, 7, 8), ["host"])


@query("a18_merge_sessions", """WITH s AS (SELECT idx, concat(CASE WHEN idx % 2 = 0 THEN 'APP' ELSE 'app' END, cast(idx % 61 AS string), '.exe') AS exe, idx % 7 = 0 AS active, name FROM fx_registry)
SELECT lower(exe) AS key, bool_or(active) AS active, arg_min(exe, idx) AS exe, arg_min(name, idx) AS name FROM s GROUP BY lower(exe)""")
def _(spark, sf):
    s = registry(spark, sf).select("idx", F.expr("concat(CASE WHEN idx % 2 = 0 THEN 'APP' ELSE 'app' END, cast(idx % 61 AS string), '.exe') AS exe"),
                                   F.expr("idx % 7 = 0 AS active"), "name")
    return Q.merge_sessions(s)
