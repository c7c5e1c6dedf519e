"""One query per operator over its whole table, with DuckDB text where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipgrove.llm import decontaminate, merkle, minhash, mixing, packing, periodic, pii, suffixes, tokenfiles, toxicity, urllists, warc, weighted
from clipgrove.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def TOKENS() -> tokenfiles.Settings:
    import public_tokenizers

    return tokenfiles.Settings(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_minhash_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(list_transform(sh, lambda g: hash(g))) AS g FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT e.u, r.c FROM e JOIN r ON e.v = r.doc_id WHERE r.c < e.u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, sh
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), minhash.Plan(words=4))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.col("toxic").alias("label")))
    return toxicity.with_score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "doc_id", "text"), path, TOKENS())
    return tokenfiles.token_digests(spark, path)


MIX_BLOCK = 16


def mix_weights(docs: DataFrame) -> DataFrame:
    """The targets of the query and the pipeline: 1 to 5 by the number in the name; other names get 1."""
    named = docs.select("source").filter(F.col("source").rlike("[0-9]")).distinct()
    return named.select("source", F.expr("1 + try_cast(regexp_extract(source, '[0-9]+', 0) as int) % 5").alias("weight"))


# slot by slot, over the blocks that are left
_EDF = """
WITH RECURSIVE s AS (
  SELECT coalesce(source, '') AS source, coalesce(max(1 + TRY_CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS INT) % 5), 1) AS w, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n
  FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY source) AS i FROM s),
l AS (SELECT list(w ORDER BY i) AS w, list(n ORDER BY i) AS n, CAST(sum(n) AS BIGINT) AS total FROM o),
r AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS rel, CAST(0 AS BIGINT) AS due,
    list_transform(n, lambda x: CAST(0 AS BIGINT)) AS c, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS b, CAST(0 AS BIGINT) AS phase FROM l
  UNION ALL
  SELECT p.t, p.pick.i, p.c[p.pick.i], p.pick.rel, p.pick.due, p.c2, CASE WHEN p.c2[p.pick.i] = p.n[p.pick.i] THEN p.c2 ELSE p.b END,
    CASE WHEN p.c2[p.pick.i] = p.n[p.pick.i] THEN p.t + 1 ELSE p.phase END
  FROM (SELECT *, list_transform(c, lambda x, k: CASE WHEN k = pick.i THEN x + 1 ELSE x END) AS c2 FROM (
    SELECT *, list_min(list_filter(list_transform(c, lambda x, k: CASE WHEN x < n[k] AND phase + (x - b[k]) * q // w[k] <= t
        THEN {'due': phase + ((x - b[k] + 1) * q + w[k] - 1) // w[k], 'i': k, 'rel': phase + (x - b[k]) * q // w[k]} END), lambda y: y IS NOT NULL)) AS pick
    FROM (SELECT r.t + 1 AS t, r.c, r.b, r.phase, l.w, l.n, l.total, CAST(list_sum(list_transform(r.c, lambda x, k: CASE WHEN x < l.n[k] THEN l.w[k] ELSE 0 END)) AS BIGINT) AS q
          FROM r, l WHERE r.t + 1 < l.total))) p),
d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS k FROM documents)
SELECT d.doc_id, d.source, k // 16 AS block, r.t AS slot, CAST(k % 16 AS INT) AS "offset", r.rel AS release, r.due
FROM d JOIN o USING (source) JOIN r ON r.i = o.i AND r.block = k // 16 AND r.t >= 0
"""


@query("op2_mix_sources", _EDF)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mix_weights(docs), MIX_BLOCK)


# Captures are fetched and lists are dated by numbers of the pages themselves, over two years from 2023 on
_START = 1_672_531_200
_FETCH = f"{_START} + page_id * 7919 % 730 * 86400 + page_id % 86400"
_HOSTS = """
SELECT 'spam' AS list, h AS pattern, {start} + m * 31 % 400 * 86400 AS "at", true AS active FROM hosts
UNION ALL SELECT 'spam', h, {start} + (m * 31 % 400 + 30 + m % 90) * 86400, false FROM hosts
UNION ALL SELECT 'spam', h, {start} + (m * 31 % 400 + 200 + m % 50) * 86400, true FROM hosts
UNION ALL SELECT 'malware', d, {start} + (100 + n % 300) * 86400, true FROM domains
UNION ALL SELECT 'malware', d, {start} + (107 + n % 300) * 86400, false FROM domains
UNION ALL SELECT 'takedown', f, {start} + f0 * 13 % 730 * 86400, true FROM folders
"""
_LISTS = _HOSTS.format(start=_START)


@query("op3_url_lists", rf"""
WITH u AS (
  SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', '')) AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p, {_FETCH} AS "at" FROM pages),
hosts AS (SELECT h, min(page_id) AS m FROM u WHERE h <> '' GROUP BY h),
domains AS (SELECT regexp_extract(h, '[^.]+[.][^.]+$') AS d, count(DISTINCT h) AS n FROM u WHERE regexp_extract(h, '[^.]+[.][^.]+$') <> '' GROUP BY 1),
folders AS (SELECT h || regexp_extract(p, '^/[^/]*/') AS f, min(page_id) AS f0 FROM u WHERE regexp_extract(p, '^/[^/]*/') <> '' GROUP BY 1),
e AS (SELECT "list", pattern, "at", bool_or(active) AS active FROM ({_LISTS}) GROUP BY ALL),
i AS (SELECT "list", pattern, "at" AS valid_from, lead("at") OVER (PARTITION BY "list", pattern ORDER BY "at") AS valid_to, active FROM e),
b AS (
  SELECT page_id, u."at", min({{'n': -length(pattern), 'list': i."list", 'pattern': pattern, 'valid_from': valid_from}}) AS m
  FROM u JOIN i ON active AND u."at" >= valid_from AND (valid_to IS NULL OR u."at" < valid_to)
    AND (h = pattern OR ends_with(h, '.' || pattern) OR h || p = pattern OR (pattern LIKE '%/' AND starts_with(h || p, pattern)))
  WHERE h <> '' GROUP BY ALL)
SELECT u.page_id, CAST(u."at" AS BIGINT) AS "at", m IS NOT NULL AS blocked, m."list" AS "list", m.pattern AS pattern, CAST(m.valid_from AS BIGINT) AS valid_from
FROM u LEFT JOIN b USING (page_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("h", urllists.host(F.col("url"))).withColumn("p", urllists.path(F.col("url")))
    hosts = pages.filter("h <> ''").groupBy("h").agg(F.min("page_id").alias("m"))
    domain = F.regexp_extract("h", "[^.]+[.][^.]+$", 0)
    domains = hosts.select(domain.alias("d"), "h").filter("d <> ''").groupBy("d").agg(F.count("*").alias("n"))
    folder = F.regexp_extract("p", "^/[^/]*/", 0)
    folders = pages.filter(folder != "").groupBy(F.concat("h", folder).alias("f")).agg(F.min("page_id").alias("f0"))
    at = lambda days: F.lit(_START) + days * 86_400
    on = lambda df, name, key, days, active: df.select(F.lit(name).alias("list"), F.col(key).alias("pattern"), at(days).alias("at"), F.lit(active).alias("active"))
    first, m, n = F.col("m") * 31 % 400, F.col("m"), F.col("n") % 300
    lists = (on(hosts, "spam", "h", first, True).unionByName(on(hosts, "spam", "h", first + 30 + m % 90, False))
             .unionByName(on(hosts, "spam", "h", first + 200 + m % 50, True)).unionByName(on(domains, "malware", "d", n + 100, True))
             .unionByName(on(domains, "malware", "d", n + 107, False)).unionByName(on(folders, "takedown", "f", F.col("f0") * 13 % 730, True)))
    return urllists.evaluate(pages.select("page_id", "url", F.expr(_FETCH).alias("at")), lists)


@query("op1_pii_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key that stays with its owner")


@query("op10_weighted_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.with_edits(table(spark, sf_dir, "documents"))


@query("op5_warc", """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM (
  SELECT page_id, html, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CAST('0x' || substr(sha1(coalesce(html, '')), CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 + 1, 1)), '') AS d FROM pages))
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_suffix_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS g1, md5(substr(h, 2 * i + 1, 400)) AS g2 FROM (
  SELECT doc_id, h, unnest(generate_series(0, n - 200)) AS i FROM b WHERE n >= 200)),
d AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY g1, g2) AS c FROM w) WHERE c > 1),
s AS (SELECT doc_id, min(i) AS f, max(i) + 200 AS t FROM (
  SELECT *, count(*) FILTER (WHERE gap IS NULL OR gap > 200) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM d) GROUP BY doc_id, part),
k AS (SELECT s.doc_id, count(*) AS spans, sum(t - f) AS gone, max(t) AS last,
  string_agg(substr(h, 2 * p + 1, 2 * (f - p)), '' ORDER BY f) AS head
  FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY f), 0) AS p FROM s) s JOIN b USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# crc32 of the decimal doc_id, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)))"""


def id_crc() -> Column:
    """Unsigned crc32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@query("op11_periodic_runs", rf"""
WITH d AS (
  SELECT doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
o AS (SELECT doc_id, h, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
k AS (SELECT *, h % 10 = 0 AS planted, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM o),
t AS (
  SELECT k.doc_id, k.i, CASE WHEN k.planted AND k.i >= k.a THEN s.w ELSE k.w END AS w
  FROM k LEFT JOIN o s ON s.doc_id = k.doc_id AND s.i = CASE WHEN k.planted AND k.i >= k.a THEN k.a + (k.i - k.a) % k.p END),
g AS (
  SELECT doc_id, i, md5(concat_ws(' ', w, {', '.join(f"lead(w, {j}) OVER x" for j in range(1, 8))})) AS gram, lead(i, 7) OVER x IS NOT NULL AS whole
  FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS part
  FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i WHERE x.whole AND y.whole),
c AS (SELECT doc_id, min(i) AS s, count(*) + 7 + q AS len, q FROM e GROUP BY doc_id, q, part HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.q < c.q AND b.s <= c.s AND b.s + b.len >= c.s + c.len)),
z AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    (list({{'s': s, 'len': len, 'q': q}} ORDER BY CAST(len AS DOUBLE) / q DESC, s, q))[1] AS best
  FROM r GROUP BY doc_id),
v AS (
  SELECT t.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.len) GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, h = table(spark, sf_dir, "documents").select("doc_id", "text"), id_crc()
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", ((h - h % 10) / 10).cast("long").alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), split).alias("words"))
    docs = docs.select("*", F.size("words").alias("n"), F.expr("cast(g % nullif(size(words), 0) as int)").alias("a"))
    docs = docs.select("*", F.expr("1 + cast((n - a) div (3 + g % 8) as int)").alias("p"))
    planted = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int) + 1)), 1, n - a)), ' ')")
    runs = periodic.find_runs(docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    best = """try_element_at(array_sort(runs, (x, y) -> case when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1)
        when x.start <> y.start then if(x.start < y.start, -1, 1) else cast(signum(x.period - y.period) as int) end), 1)"""
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


def _leaf_sql(text: str) -> str:
    each = ["doc_id", "source", "lang", "n_chars", text]
    return f"""sha256({" || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in each)})"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(_LOWER)} ELSE {_leaf_sql("text")} END AS seen FROM documents),
o AS (SELECT *, row_number() OVER x - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r FROM l WINDOW x AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
t AS (
  SELECT tree, 0 AS level, i, leaf AS h, n FROM o
  UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY tree, level, i // 16, n),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, i, h, n FROM s
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, i // 16, n),
g AS (
  SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 'top', level, i // 16, list(h ORDER BY i) FROM u WHERE n > 1 GROUP BY ALL),
p AS (
  SELECT r, tree, 0 AS level, i, seen AS h, '' AS proof FROM o
  UNION ALL
  SELECT r, p.tree, p.level + 1, i // 16, sha256(array_to_string(hs[:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], '')),
    proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
  FROM p JOIN g ON g.tree = p.tree AND g.level = p.level AND g.run = i // 16),
a AS (SELECT r, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM p GROUP BY ALL),
q AS (
  SELECT r, 0 AS level, s.i, a.h, proof FROM a JOIN s USING (tree)
  UNION ALL
  SELECT r, q.level + 1, i // 16, sha256(array_to_string(hs[:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], '')),
    proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
  FROM q JOIN g ON g.tree = 'top' AND g.level = q.level AND g.run = i // 16),
f AS (SELECT r, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM q GROUP BY r)
SELECT o.doc_id, o.leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM o JOIN f USING (r) JOIN s USING (tree) JOIN u ON u.n = 1
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest = lambda text: merkle.leaf(**{str(i): c for i, c in enumerate([*fields, text])})
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), digest(F.col("text")).alias("leaf"),
                       F.when(id_crc() % 5 == 0, digest(lower)).alias("tampered"))
    rows = rows.select("id", "group", "leaf", F.coalesce("tampered", "leaf").alias("seen"))
    out = merkle.manifest(rows, scratch(spark, "manifest"))
    folded = merkle.fold(F.col("seen"), F.col("proof"))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof.siblings", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "windows")
    packing.write_windows(table(spark, sf_dir, "documents"), path, packing.Window(TOKENS().tokenizer))
    return packing.piece_digests(spark, path)
