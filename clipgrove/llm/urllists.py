"""URL filters over dated lists: entries become validity intervals, captures meet those of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = 86_400


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a dot at the end; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"[.]?(:[0-9]*)?$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _entry(pattern: Column) -> Column:
    """A pattern with its host in lower case; paths are as they are written."""
    name = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(name), F.substr(pattern, F.length(name) + 1))


def patterns(url: str, labels: int, folders: int) -> Column:
    """What a list entry may say to match the URL: its host and every parent domain of at most ``labels`` labels, and the host with each
    leading part of its path that ends in one of the first ``folders`` slashes, and with the whole path."""
    h, p = host(F.col(url)), path(F.col(url))
    names = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda i: F.array_join(F.slice(names, -i, i), "."))
    parts = F.slice(F.split(p, "/", folders + 1), 1, folders)  # what lies behind is not split
    slashes = F.least(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))), F.lit(folders))
    starts = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda i: F.concat(h, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    whole = F.concat(F.coalesce(starts, F.array().cast("array<string>")), F.array(F.concat(h, p)))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.when(F.lit(labels) > 0, domains).otherwise(F.array().cast("array<string>")), whole)))


def intervals(entries: DataFrame, bucket: int = 30 * DAY) -> DataFrame:
    """``entries`` (list, pattern, at, active) to list, pattern, valid_from, valid_to (null: still valid).

    An entry holds until the next one of its list and pattern; of several at one time an active one wins. The next
    entry is looked up inside buckets of time and, at the end of a bucket, in a table with one row per bucket,
    so a pattern with any number of entries is spread over tasks."""
    e = (entries.select(F.col("list").cast("string").alias("list"), _entry(F.col("pattern").cast("string")).alias("pattern"), F.col("at").cast("long").alias("at"),
                        F.col("active").cast("boolean").alias("active")).dropna()
         .groupBy("list", "pattern", "at").agg(F.max("active").alias("active")).withColumn("bucket", F.expr(f"at div {bucket}")))
    firsts = e.groupBy("list", "pattern", "bucket").agg(F.min("at").alias("start"))
    firsts = firsts.select("list", "pattern", "bucket", F.lead("start").over(W.partitionBy("list", "pattern").orderBy("bucket")).alias("later"))
    inside = e.withColumn("next", F.lead("at").over(W.partitionBy("list", "pattern", "bucket").orderBy("at")))
    return (inside.join(firsts, ["list", "pattern", "bucket"]).filter("active")
            .select("list", "pattern", F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to")))


def evaluate(captures: DataFrame, entries: DataFrame, bucket: int = 30 * DAY) -> DataFrame:
    """Every row of ``captures`` (page_id, url, at) with blocked and, of the entry that decides, list, pattern, valid_from: the
    longest pattern active at ``at`` (ties: the first list by name, then pattern). ``at`` in both tables is in whole seconds.

    Captures and intervals meet by pattern and bucket of time; an interval lies in every bucket that it covers up to the last
    capture. Repeated rows, other urls of one page_id and time, and rows with a null page_id each have their own row; a null url
    or time is never blocked; URLs without a host match nothing. Hosts
    are compared in lower case, paths as they are written. A URL of any length gives at most as many patterns as the labels and slashes of
    the deepest list entry, and one for its whole path. Only the named columns are read."""
    c = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("at").cast("long").alias("at"), F.col("url").cast("string").alias("url"),
                        F.monotonically_increasing_id().alias("row"))
    name = F.substring_index("pattern", "/", 1)
    labels, folders = entries.select(F.col("pattern").cast("string").alias("pattern")).agg(
        F.coalesce(F.max(F.size(F.split(name, r"\."))), F.lit(1)), F.coalesce(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))), F.lit(0))).first()
    last, = c.agg(F.max(F.expr(f"at div {bucket}"))).first()
    spans = intervals(entries, bucket)
    end = F.least(F.coalesce(F.expr(f"(valid_to - 1) div {bucket}"), F.lit(last or 0)), F.lit(last or 0))
    spans = (spans.withColumn("first", F.expr(f"valid_from div {bucket}")).withColumn("end", end).filter("first <= end")
             .select("list", "pattern", "valid_from", "valid_to", F.explode(F.sequence("first", "end")).alias("bucket")))
    keys = c.select("row", "page_id", "at", F.explode_outer(patterns("url", labels, max(1, folders))).alias("pattern")).withColumn("bucket", F.expr(f"at div {bucket}"))
    # AQE splits a hot host on the capture side
    met = keys.join(spans, (keys.pattern == spans.pattern) & (keys.bucket == spans.bucket) & (keys["at"] >= spans.valid_from)
                    & (spans.valid_to.isNull() | (keys["at"] < spans.valid_to)), "left").select(
        "row", "page_id", "at", F.when(spans.pattern.isNotNull(), F.struct(-F.length(spans.pattern), spans["list"].alias("list"), spans.pattern.alias("pattern"), spans.valid_from.alias("valid_from"))).alias("m"))
    best = met.groupBy("row", "page_id", "at").agg(F.min("m").alias("m"))
    return best.select("page_id", "at", F.col("m").isNotNull().alias("blocked"), "m.list", "m.pattern", "m.valid_from")
