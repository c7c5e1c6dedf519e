"""Clip catalog: overlay, search, facets, order, pages, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clipgrove.functions import text
from clipgrove.operators.scan import Run, first_per_key, neighbours, repack, rows_chunk, running
from clipgrove.session import cut

TOP_ROWS = 100_000


# --- order -----------------------------------------------------------------------------

def ordinal(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """0-based position of every row in a total order. A range sort spreads the rows (ties
    included, ``order`` is unique), then each partition only needs its start position."""
    placed = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort partition, so a single window and a broadcast are safe here.
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_start") + inside).cast("bigint"))
        .drop("_id", "_part", "_start")
    )


def newest_first(oldest: bool = False) -> list[Column]:
    """Newest first, path as tiebreak; ``oldest`` is the exact reverse."""
    if oldest:
        return [F.col("modified_ms").asc(), F.col("path").desc()]
    return [F.col("modified_ms").desc(), F.col("path").asc()]


def page(df: DataFrame, offset: int = 0, limit: int | None = 100, oldest: bool = False, top_rows: int = TOP_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``. Pages that end within ``top_rows`` are a top-k, whose rows meet in one task, so it
    bounds them; others are cut by position. Both give the same rows."""
    order = newest_first(oldest)
    if limit is None and offset == 0:
        return df.orderBy(*order)
    if limit is not None and offset + limit <= top_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    # A deep page by position: a top-k that large would sit in one task.
    placed = ordinal(df, order, "_pos")
    keep = F.col("_pos") >= offset
    if limit is not None:
        keep = keep & (F.col("_pos") < offset + limit)
    return placed.where(keep).orderBy("_pos").drop("_pos")


def page_summary(df: DataFrame, offset: int = 0, limit: int | None = 100) -> DataFrame:
    total = F.count(F.lit(1))
    left = F.greatest(total - F.lit(offset), F.lit(0))
    got = left if limit is None else F.least(left, F.lit(limit))
    return df.agg(
        total.cast("bigint").alias("total"),
        got.cast("bigint").alias("rows"),
        (F.lit(offset) + got < total).alias("has_more"),
    )


def clip_neighbours(df: DataFrame, order: list[Column]) -> DataFrame:
    """Previous and next path in the displayed order."""
    return neighbours(
        ordinal(df, order), [], ["pos"], rows_chunk("pos"),
        {"prev_path": F.col("path")}, {"next_path": F.col("path")},
    )


def dedup_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return first_per_key(df, [key], order)


def union_roots(*lists: DataFrame) -> DataFrame:
    """Union of root lists (path, idx) in the given order, unique ignoring case."""
    tagged = [
        d.select(text.strip(F.col("path")).alias("path"), F.lit(i).alias("list_no"), F.col("idx").cast("bigint").alias("idx"))
        for i, d in enumerate(lists)
    ]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    out = out.where(F.col("path") != "")
    return first_per_key(out, [F.lower("path")], [F.col("list_no"), F.col("idx")])


def append_pages(shown: DataFrame, page_rows: DataFrame, key: str = "path") -> DataFrame:
    """Pages put together: of rows with one id the earlier one stays. ``pos`` orders a page."""
    both = shown.withColumn("_page", F.lit(0)).unionByName(page_rows.withColumn("_page", F.lit(1)))
    return first_per_key(both, [F.col(key)], [F.col("_page"), F.col("pos")])


def next_offset(page_rows: DataFrame, offset: int) -> DataFrame:
    """The offset moves on by the rows received, repeated ones too."""
    return page_rows.agg((F.count(F.lit(1)) + F.lit(offset)).cast("bigint").alias("next_offset"))


# --- overlay and filters ---------------------------------------------------------------

def overlay(clips: DataFrame, meta: DataFrame, key: str = "path") -> DataFrame:
    """Hand-made metadata on top of detected one; both labels are kept."""
    m = meta.select(key, "game", F.col("cover").alias("_cover"), F.col("cover_ms").alias("_cover_ms"), F.col("derived_from").alias("_from"))
    drop = [c for c in ("cover", "cover_ms", "exported", "source") if c in clips.columns]
    return (
        clips.drop(*drop).join(m, key, "left")
        .withColumn("source", text.effective_label(F.col("game"), F.col("detected")))
        .withColumn("cover", F.col("_cover"))
        .withColumn("cover_ms", F.coalesce(F.col("_cover_ms"), F.lit(0)).cast("bigint"))
        .withColumn("exported", F.col("_from").isNotNull())
        .drop("game", "_cover", "_cover_ms", "_from")
    )


def mark_edited(clips: DataFrame, edited_keys: DataFrame, key: str = "path") -> DataFrame:
    """``edited`` = the clip has a real (not no-op) edit."""
    marks = edited_keys.select(key).distinct().withColumn("_edited", F.lit(True))
    return clips.drop("edited").join(marks, key, "left").withColumn("edited", F.coalesce("_edited", F.lit(False))).drop("_edited")


def search(df: DataFrame, query: str, word: str = "Screen", title: str = "title", source: str = "source") -> DataFrame:
    q = query.strip().lower()
    if not q:
        return df
    fields = [F.col(title), F.col(source), text.localize_label(F.col(source), word)]
    return df.where(text.any_of([F.contains(F.lower(f), F.lit(q)) for f in fields]))


def facet_filter(df: DataFrame, edited: bool = False, sources: list[str] | None = None) -> DataFrame:
    """No facet = all rows; several = any of them."""
    wanted = []
    if edited:
        wanted.append(F.col("edited") | F.col("exported"))
    if sources:
        wanted.append(F.col("source").isin(*sources))
    return df.where(text.any_of(wanted)) if wanted else df


def facets(df: DataFrame) -> DataFrame:
    """(kind, value) of the facets on offer; kind 'edited' has one row if any clip is."""
    src = F.col("source")
    values = df.where(F.coalesce(src, F.lit("")) != "").select(
        F.when(text.is_screen(src), "screen").otherwise("game").alias("kind"), src.alias("value")
    ).distinct()
    flag = df.where("edited OR exported").select(F.lit("edited").alias("kind"), F.lit("").alias("value")).distinct()
    return values.unionByName(flag).orderBy("kind", "value")


def group_cover(df: DataFrame) -> DataFrame:
    """Newest own cover of every source; of equal times the first in list order."""
    with_cover = df.where(F.coalesce(F.col("cover"), F.lit("")) != "").select("source", "cover", "modified_ms", "path")
    return first_per_key(with_cover, [F.col("source")], [-F.col("modified_ms"), F.col("path")]).select("source", "cover")


def detected_source(clips: DataFrame, tags: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Embedded tag (Matroska files cannot carry one), else the sidecar of the same stem, else ''."""
    path = F.col("path")
    can_tag = ~text.file_ext(path).isin("mkv", "webm")
    t = tags.select("path", F.col("source").alias("_tag"))
    s = sidecars.select(F.col("dir").alias("_dir"), F.col("stem").alias("_stem"), F.col("source").alias("_side"))
    c = clips.withColumn("_dir", text.folder(path)).withColumn("_stem", text.file_stem(path))
    out = c.join(t, "path", "left").join(s, ["_dir", "_stem"], "left")
    value = F.coalesce(F.when(can_tag, F.col("_tag")), F.col("_side"), F.lit(""))
    return out.withColumn("detected", value).drop("_tag", "_side", "_dir", "_stem")


# --- names -----------------------------------------------------------------------------

def validate_renames(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests(path, new_name) -> code empty / chars / exists / ok and the new path."""
    path = F.col("path")
    raw_ext = F.regexp_extract(text.file_name(path), r"^.+\.([^.]*)$", 1)
    ext = F.when(raw_ext != "", raw_ext).otherwise(text.DEFAULT_EXT)
    new_path = F.concat(text.folder(path), F.lit("/"), text.strip(F.col("new_name")), F.lit("."), ext)
    taken = catalog.select(F.col("path").alias("new_path")).distinct().withColumn("_taken", F.lit(True))
    out = requests.withColumn("new_path", new_path).join(taken, "new_path", "left")
    code = text.name_code(F.col("new_name"), F.coalesce("_taken", F.lit(False)), F.col("new_path") == path)
    return out.withColumn("code", code).drop("_taken")


def assign_free_names(requests: DataFrame, catalog: DataFrame, ext: str = "mp4", last: int = 999) -> DataFrame:
    """requests(req_id, dir, stem): the first unused of stem, stem_2 ... stem_<last>; later
    requests of a batch see the names given to earlier ones. Beyond it the plain stem.

    The k-th free number is k plus the taken numbers t_j with t_j - (j - 1) <= k, which is a
    running count over both sides; no list of candidates is built."""
    keys = ["dir", "stem"]
    name = text.file_name(F.col("path"))
    files = catalog.where(text.file_ext(F.col("path")) == ext).select(
        text.folder(F.col("path")).alias("dir"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1).alias("_name")
    )
    suffix = F.regexp_extract("_name", r"_([1-9][0-9]{0,9})$", 1).try_cast("bigint")
    number = F.when(suffix >= 2, suffix)  # the first suffix in use is 2
    taken = (
        files.select("dir", F.explode(F.array(
            F.struct(F.col("_name").alias("stem"), F.lit(1).cast("bigint").alias("n")),
            F.struct(F.regexp_extract("_name", r"^(.+)_[1-9][0-9]*$", 1).alias("stem"), number.alias("n")),
        )).alias("t"))
        .select("dir", "t.stem", "t.n")
        .where((F.col("stem") != "") & F.col("n").between(1, last))
        .distinct()
    )
    wanted = taken.join(requests.select(*keys).distinct(), keys, "left_semi")
    # At most `last` taken numbers per name, so a plain window is bounded.
    j = F.row_number().over(W.partitionBy(*keys).orderBy("n"))
    holes = wanted.withColumn("_at", (F.col("n") - j + 1).cast("bigint")).select(
        *keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("req_id"), F.lit(1).alias("_hole"))
    ranked = repack(requests.select("req_id", *keys), keys, ["req_id"], rows_chunk("req_id"), "_k")
    asks = ranked.select(*keys, (F.col("_k") + 1).alias("_at"), F.lit(1).alias("_side"), "req_id", F.lit(0).alias("_hole"))
    both = holes.unionByName(asks)
    seen = running(both, keys, ["_at", "_side", "req_id"], {"_before": Run("sum", F.col("_hole").cast("bigint"))}, rows_chunk("_at"))
    n = F.col("_at") + F.coalesce(F.col("_before"), F.lit(0))
    free = F.when(n == 1, F.col("stem")).when(n <= last, F.concat("stem", F.lit("_"), n.cast("string"))).otherwise(F.col("stem"))
    return seen.where("_side = 1").select("req_id", *keys, free.alias("name"))

