"""Views with the shapes of clips, segments, packets ... derived from the given tables.

One text per view serves Spark and DuckDB; only the three tokens of ``TOKENS`` differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_LINE_RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

VIEWS = {
    "fx_clips": """
SELECT p_partkey AS clip_no,
  concat('/r', cast(p_partkey % 3 AS string), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey AS string), '.',
    CASE p_partkey % 6 WHEN 0 THEN 'MP4' WHEN 1 THEN 'mp4' WHEN 2 THEN 'mov' WHEN 3 THEN 'mkv' WHEN 4 THEN 'webm' ELSE 'txt' END) AS path,
  p_name AS title,
  cast(round(p_retailprice * 10000) AS bigint) AS size_bytes,
  1700000000000 + cast(floor(p_partkey / 4) AS bigint) * 60000 AS modified_ms,
  p_size * cast(1.5 AS double) AS duration_sec,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN concat('Pantalla ', cast(p_partkey % 3 + 1 AS string)) ELSE p_brand END AS detected,
  CASE p_partkey % 4 WHEN 0 THEN 1280 WHEN 1 THEN 1920 WHEN 2 THEN 2560 ELSE 3840 END AS width,
  CASE p_partkey % 4 WHEN 0 THEN 720 WHEN 1 THEN 1080 WHEN 2 THEN 1440 ELSE 2160 END AS height,
  CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 60 ELSE 240 END AS fps,
  CASE p_partkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' WHEN 3 THEN 'veryhigh' ELSE 'ultra' END AS quality
FROM part""",
    "fx_overlay": """
SELECT p_partkey AS clip_no,
  CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_type, ' ') END AS game,
  CASE WHEN p_partkey % 3 = 0 THEN concat('/covers/', cast(p_partkey AS string), '.png') END AS cover,
  CASE WHEN p_partkey % 3 = 0 THEN 1700000000000 + p_partkey ELSE 0 END AS cover_ms,
  CASE WHEN p_partkey % 25 = 0 AND p_partkey > 0 THEN p_partkey - 5 END AS derived_from_no
FROM part WHERE p_partkey % 5 = 0""",
    "fx_playlist": f"""
SELECT l_orderkey AS playlist_id,
  cast({_LINE_RANK} - 1 AS bigint) AS idx,
  CASE WHEN l_partkey % 17 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS clip_no,
  CASE WHEN l_tax = 0 THEN 0 ELSE cast(floor(@US(l_shipdate) / 1000) AS bigint) END AS added_ms,
  l_returnflag = 'R' AS seen
FROM lineitem""",
    "fx_playlists": """
SELECT o_orderkey AS playlist_id, concat('list ', cast(o_orderkey AS string)) AS name,
  cast(floor(@US(o_orderdate) / 1000) AS bigint) AS created_ms,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 100 END AS pos
FROM orders""",
    "fx_segments": f"""
SELECT clip, idx, start_ms, start_ms + len_ms AS end_ms, idx * cast(1500 AS double) AS pos_ms,
  start_ms AS bound_start_ms, start_ms + 1000 AS bound_end_ms, disabled
FROM (SELECT l_orderkey AS clip,
    cast({_LINE_RANK} - 1 AS bigint) AS idx,
    ({_LINE_RANK} - 1) * cast(2000 AS double) AS start_ms,
    l_quantity * 20 AS len_ms, l_linestatus = 'O' AS disabled
  FROM lineitem) s""",
    "fx_edits": """
SELECT o_orderkey AS clip,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'vertical' ELSE 'horizontal' END AS format_kind,
  CASE WHEN o_orderkey % 10 = 0 THEN cast(0.5 AS double) ELSE cast(0 AS double) END AS brightness,
  CASE WHEN o_orderkey % 4 = 0 THEN cast(0.5 AS double) ELSE cast(1 AS double) END AS sys_vol,
  o_orderkey % 6 = 0 AS mic_muted
FROM orders""",
    "fx_packets": """
SELECT p.stream_id, seq, p.segment, track, time, time - t0 AS seg_time, dur, key, size, width
FROM (SELECT user_id % 8 AS stream_id, event_id AS seq, cast(floor(event_id / 2500) AS bigint) AS segment,
    CASE WHEN event_type = 'error' THEN 'a' ELSE 'v' END AS track,
    (@US(ts) - 1704067200000000) * 10 AS time,
    cast(round(value * 10) AS bigint) * 10000000 AS dur,
    event_type = 'signup' AS key,
    cast(round(value * 100) AS bigint) AS size,
    CASE WHEN floor(event_id / 2500) = 2 THEN 1280 ELSE 1920 END AS width
  FROM events) p
JOIN (SELECT user_id % 8 AS stream_id, cast(floor(event_id / 2500) AS bigint) AS segment,
    min((@US(ts) - 1704067200000000) * 10) AS t0 FROM events GROUP BY 1, 2) m
  ON p.stream_id = m.stream_id AND p.segment = m.segment""",
    "fx_frames": """
SELECT user_id AS clip, event_id AS seq, cast(floor((@US(ts) - 1704067200000000) * 10 / 180000) AS bigint) AS t, event_type = 'signup' AS key FROM events""",
    "fx_requests": """
SELECT event_id AS request_id, user_id % 8 AS stream_id, (@US(ts) - 1704067200000000) * 10 AS at FROM events WHERE event_id % 97 = 0""",
    "fx_logs": """
SELECT event_id AS n,
  CASE event_id % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'app::capture::win' WHEN 2 THEN 'ui' WHEN 3 THEN 'app_other' ELSE 'other::x' END AS target,
  concat(@TS(ts), ' ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN ' ELSE 'INFO ' END, ' ',
    CASE event_id % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'capture::win' WHEN 2 THEN 'ui' WHEN 3 THEN 'app_other' ELSE 'other::x' END,
    ': user ', cast(user_id AS string), ' ', props) AS line
FROM events""",
    "fx_procs": """
SELECT c_custkey + 1 AS pid, cast(floor(c_custkey / 4) AS bigint) AS parent,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'explorer.exe' WHEN 'MACHINERY' THEN 'discord.exe' WHEN 'BUILDING' THEN 'msedgewebview2.exe'
    WHEN 'AUTOMOBILE' THEN 'javaw.exe' ELSE 'game.exe' END AS exe,
  concat('c:/lib', cast(c_nationkey AS string), '/', CASE WHEN c_nationkey % 5 = 0 THEN 'steamapps/common/dir' ELSE 'apps/minecraft' END,
    cast(c_custkey % 50 AS string), '/x.exe') AS path
FROM customer""",
    "fx_registry": """
SELECT p_partkey AS idx, p_name AS name,
  concat(CASE WHEN p_partkey % 9 = 0 THEN '>' ELSE '' END, 'Bin/', p_type, '_', cast(p_size AS string), CASE WHEN p_partkey % 13 = 0 THEN '.app' ELSE '.EXE' END) AS exe,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'darwin' ELSE 'win32' END AS os,
  p_partkey % 10 = 0 AS is_launcher,
  CASE WHEN p_partkey % 19 = 0 THEN '-x' END AS arguments,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat('h', cast(p_partkey AS string)) END AS icon_hash
FROM part""",
    "fx_names": """
SELECT p_partkey AS idx, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part""",
    "fx_files": """
SELECT doc_id, source AS kind, concat(source, '/', lang, '/', cast(doc_id AS string)) AS path, n_chars AS bytes,
  CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 1700000000000 + doc_id * 3600000 END AS mtime_ms
FROM documents""",
    "fx_samples": """
SELECT label AS stream_id, vec_id AS source, cast(frame AS bigint) AS frame, cast(round(cast(x AS double) * 60000) AS int) AS sample
FROM embeddings @EXPLODE""",
    "fx_runs": f"""
SELECT l_orderkey AS clip,
  cast({_LINE_RANK} - 1 AS bigint) AS i,
  cast(l_quantity AS int) AS n, l_linenumber * 1000 AS delta
FROM lineitem""",
}

TOKENS = {
    "spark": {
        "US": r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(\1 AS timestamp_ntz))",
        "TS": r"date_format(\1, 'yyyy-MM-dd HH:mm:ss.SSS')",
        "EXPLODE": "LATERAL VIEW posexplode(embedding) q AS frame, x",
    },
    "duckdb": {
        "US": r"epoch_us(\1)",
        "TS": r"strftime(\1, '%Y-%m-%d %H:%M:%S.%g')",
        "EXPLODE": ", LATERAL (SELECT unnest(range(len(embedding))) AS frame, unnest(embedding) AS x) q",
    },
}


def view_sql(name: str, engine: str) -> str:
    tokens = TOKENS[engine]
    text = VIEWS[name]
    for token in ("US", "TS"):
        text = re.sub(rf"@{token}\(([^)]*)\)", tokens[token], text)
    return text.replace("@EXPLODE", tokens["EXPLODE"]).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables of ``sf_dir``."""
    text = re.sub(
        rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b",
        lambda m: f"{m.group(1)} parquet.`{sf_dir}/{m.group(2)}.parquet`",
        view_sql(name, "spark"),
    )
    return spark.sql(text)


def with_views(sql: str) -> str:
    """DuckDB text with the views it names put in front as CTEs."""
    body = sql.strip()
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = [f"{v} AS ({view_sql(v, 'duckdb')})" for v in used]
    recursive = ""
    if re.match(r"WITH RECURSIVE\b", body):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE"):].strip()
        ctes.append(body)
    elif re.match(r"WITH\b", body):
        ctes.append(body[len("WITH"):].strip())
    elif not ctes:
        return body
    else:
        return f"WITH {', '.join(ctes)}\n{body}"
    return f"WITH {recursive}{', '.join(ctes)}"
