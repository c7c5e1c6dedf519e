"""Playlists and their ordered entries (playlist_id, idx, <key>, added_ms, seen).

``key`` names the clip column. Every list operation takes requests for many playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.functions import text
from clipgrove.operators.scan import CHUNK_ROWS, first_per_key, repack, rows_chunk

# Fixed values.
FRESH_MS = 7 * 24 * 3600 * 1000
SLOTS = 4

LIST = "playlist_id"
MONTH_MS = 30 * 24 * 3600 * 1000


# --- reads -----------------------------------------------------------------------------

def resolve(entries: DataFrame, clips: DataFrame, key: str = "path") -> DataFrame:
    """Entries that the catalog knows, with the clip columns; ``idx`` keeps the list order."""
    return entries.join(clips, key)


def dangling(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Rows without a partner: entries without a clip, derived files without a clip."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def fresh(entries: DataFrame, now_ms: int) -> DataFrame:
    return entries.where(~F.col("seen") & (F.col("added_ms") > 0) & (F.lit(now_ms) - F.col("added_ms") < FRESH_MS))


def membership(selection: DataFrame, entries: DataFrame, pairs: DataFrame | None = None, key: str = "path") -> DataFrame:
    """(selection_id, playlist_id, state): ``in`` when all clips of a selection are in the list,
    ``partial`` when some are. Without ``pairs`` only lists that hold a clip appear, each a row of the result; the asked
    ``pairs`` (selection_id, playlist_id) also get ``out``, and only their clips are counted."""
    total = selection.groupBy("selection_id").agg(F.count(F.lit(1)).alias("_total"))
    held = entries.select(LIST, key).distinct()
    if pairs is None:
        held_clips = selection.join(held, key)
    else:  # by the asked pairs, so a clip that many selections and many lists share makes no product
        held_clips = pairs.select("selection_id", LIST).distinct().join(selection, "selection_id").join(held, [LIST, key])
    n = held_clips.groupBy("selection_id", LIST).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.coalesce("_n", F.lit(0)) == 0, "out").when(F.col("_n") == F.col("_total"), "in").otherwise("partial")
    base = n if pairs is None else pairs.join(n, ["selection_id", LIST], "left")
    return base.join(total, "selection_id", "left").select("selection_id", LIST, state.alias("state"))


def playlists_of(entries: DataFrame, key: str = "path") -> DataFrame:
    """(key, playlist_id) once per list that holds the clip. Rows, not an array: one clip may be
    in very many lists."""
    return entries.select(key, LIST).distinct()


def totals(entries: DataFrame, clips: DataFrame, key: str = "path") -> DataFrame:
    return resolve(entries, clips.select(key, "duration_sec"), key).groupBy(LIST).agg(
        F.sum("duration_sec").alias("total_sec"), F.count(F.lit(1)).alias("clips"))


def source_histogram(resolved: DataFrame) -> DataFrame:
    """resolved(playlist_id, source) -> (playlist_id, source, n, screen). All screens of a list
    share one slot named after the different screens in natural order. Both branches read the
    same counts, so the rows are shuffled once, pre-aggregated."""
    counts = resolved.where(F.coalesce("source", F.lit("")) != "").groupBy(LIST, "source").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("screen", text.is_screen(F.col("source")))
    games = counts.where(~F.col("screen")).select(LIST, "source", "n", "screen")

    def ranked(name: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_replace(name, "[0-9]+$", "")).alias("prefix"),
            F.regexp_extract(name, "([0-9]+)$", 1).try_cast("bigint").alias("number"), name.alias("name"))

    # One entry per distinct screen label of a list.
    merged = counts.where("screen").groupBy(LIST).agg(F.collect_list("source").alias("_labels"), F.sum("n").alias("n"))
    parts = F.flatten(F.transform("_labels", lambda s: F.split(s, text.LABEL_SEPARATOR)))
    names = F.array_sort(F.array_distinct(F.transform(parts, lambda p: ranked(text.strip(p)))))
    title = F.array_join(F.transform(names, lambda r: r["name"]), text.LABEL_SEPARATOR)
    return games.unionByName(merged.select(LIST, title.alias("source"), "n", F.lit(True).alias("screen")))


def top_slots(histogram: DataFrame, k: int = SLOTS) -> DataFrame:
    """The first ``k`` sources by count, then name; the number that do not fit and the names
    from the last slot on. A list is gathered as its distinct sources."""
    slot = F.struct((-F.col("n")).alias("by"), "source", "n", "screen")
    lists = histogram.groupBy(LIST).agg(F.array_sort(F.collect_list(slot)).alias("_all"))
    size = F.size("_all")
    rest = F.when(size >= k, F.slice("_all", F.lit(k), F.greatest(size - (k - 1), F.lit(1)))).otherwise(F.slice("_all", 1, 0))
    hidden = F.array_join(F.transform(rest, lambda r: r["source"]), text.LABEL_SEPARATOR)
    over = F.when(size > k, size - (k - 1)).otherwise(0).cast("bigint")
    shown = lists.select(LIST, over.alias("overflow"), hidden.alias("hidden"), F.posexplode(F.slice("_all", 1, k)).alias("_i", "_s"))
    return shown.select(LIST, (F.col("_i") + 1).cast("bigint").alias("slot"), "_s.source", "_s.n", "_s.screen", "overflow", "hidden")


# --- order -----------------------------------------------------------------------------

def sort_keys(mode: str) -> list[Column]:
    """Order of the rows of a list by mode; ``idx`` settles ties."""
    if mode == "custom":
        return [F.lit(0).cast("bigint"), F.col("idx")]
    if mode == "added":  # undated (0) entries last, of equal dates the later entry first
        return [-F.coalesce("added_ms", F.lit(0)), -F.col("idx")]
    if mode == "newest":
        return [-F.col("modified_ms"), F.col("idx")]
    if mode == "oldest":
        return [F.col("modified_ms"), F.col("idx")]
    raise ValueError(mode)


def sort_by(df: DataFrame, mode: str) -> DataFrame:
    return df.orderBy(LIST, *sort_keys(mode))


def sort_positions(df: DataFrame, mode: str, out: str = "place") -> DataFrame:
    """0-based place of every row in its list under ``mode``."""
    first, second = sort_keys(mode)
    keyed = df.withColumn("_a", first.cast("bigint")).withColumn("_b", second.cast("bigint"))
    # Equal first keys at 0 (undated, custom) are cut by the second key.
    chunk = F.struct(
        F.floor(F.col("_a") / MONTH_MS), F.when(F.col("_a") == 0, F.floor(F.col("_b") / CHUNK_ROWS)).otherwise(0))
    if mode in ("newest", "oldest"):
        chunk = F.floor(F.col("_a") / MONTH_MS)
    return repack(keyed, [LIST], ["_a", "_b"], chunk, out).drop("_a", "_b")


def order_playlists() -> list[Column]:
    """Never moved first, newest first; then by position."""
    pos = F.col("pos")
    return [pos.isNotNull().asc(), F.when(pos.isNull(), -F.col("created_ms")).asc(), pos.asc(), F.col(LIST).asc()]


def reorder_playlists(playlists: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(playlist_id, place): position = place in the given list, NULL if not in it."""
    first = ids.groupBy(LIST).agg(F.min("place").alias("_place"))
    return playlists.drop("pos").join(first, LIST, "left").withColumnRenamed("_place", "pos")


# --- changes ---------------------------------------------------------------------------

def add_entries(entries: DataFrame, adds: DataFrame, now_ms: int, playlists: DataFrame | None = None, key: str = "path") -> DataFrame:
    """adds(playlist_id, place, key): new clips go to the end in arrival order; clips already in
    a list keep place, date and mark. Unknown lists are ignored when ``playlists`` is given."""
    new = adds.join(entries.select(LIST, key).distinct(), [LIST, key], "left_anti")
    if playlists is not None:
        new = new.join(playlists.select(LIST), LIST, "left_semi")
    new = first_per_key(new.select(LIST, key, "place"), [F.col(LIST), F.col(key)], [F.col("place")])
    ranked = repack(new, [LIST], ["place"], rows_chunk("place"), "_rank")
    ends = entries.groupBy(LIST).agg((F.max("idx") + 1).alias("_n"))
    tail = ranked.join(ends, LIST, "left").select(
        LIST, (F.coalesce("_n", F.lit(0)) + F.col("_rank")).cast("bigint").alias("idx"), key,
        F.lit(now_ms).cast("bigint").alias("added_ms"), F.lit(False).alias("seen"))
    return entries.select(LIST, "idx", key, "added_ms", "seen").unionByName(tail)


def _packed(entries: DataFrame) -> DataFrame:
    old = entries.withColumnRenamed("idx", "_old")
    return repack(old, [LIST], ["_old"], rows_chunk("_old")).drop("_old")


def remove_entries(entries: DataFrame, dels: DataFrame, key: str = "path") -> DataFrame:
    """dels(playlist_id, key), or (key) for every list; places close up."""
    on = [c for c in (LIST, key) if c in dels.columns]
    return _packed(entries.join(dels.select(*on).distinct(), on, "left_anti"))


def restore_entries(entries: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """removed(playlist_id, old_idx, key, added_ms, seen): entries go back to their old places,
    low places first, each clamped to the length reached by then; clips present again are
    skipped. Old places come from one list, so they differ within a playlist.

    The k-th restored entry lands at min(old_k, n + k) (k from 0), so it comes before the
    kept entry of rank old_k - k: one ordering of both sides gives all places."""
    back = removed.join(entries.select(LIST, key).distinct(), [LIST, key], "left_anti")
    back = first_per_key(back, [F.col(LIST), F.col(key)], [F.col("old_idx")])
    back = repack(back, [LIST], ["old_idx"], rows_chunk("old_idx"), "_k")
    size = entries.groupBy(LIST).agg(F.count(F.lit(1)).alias("_n"))
    back = back.join(size, LIST, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    cols = [LIST, key, "added_ms", "seen"]
    put = back.select(*cols, (F.least(F.col("old_idx"), F.col("_n") + F.col("_k")) - F.col("_k")).alias("_slot"),
                      F.lit(0).alias("_side"), F.col("_k").alias("_tie"))
    stay = _packed(entries).select(*cols, F.col("idx").alias("_slot"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"))
    return repack(put.unionByName(stay), [LIST], ["_slot", "_side", "_tie"], rows_chunk("_slot")).select(LIST, "idx", key, "added_ms", "seen")


def _known(entries: DataFrame, key: str) -> DataFrame:
    """First entry of every (list, clip)."""
    return first_per_key(entries, [F.col(LIST), F.col(key)], [F.col("idx")])


def set_order(entries: DataFrame, order: DataFrame, now_ms: int, key: str = "path") -> DataFrame:
    """order(playlist_id, place, key): the whole new list of the named playlists. Known clips
    keep date and mark, others are new, entries not listed go; other playlists stay."""
    known = _known(entries, key).select(LIST, key, "added_ms", "seen")
    placed = repack(order.select(LIST, "place", key), [LIST], ["place"], rows_chunk("place"))
    new = placed.join(known, [LIST, key], "left").select(
        LIST, "idx", key, F.coalesce("added_ms", F.lit(now_ms)).cast("bigint").alias("added_ms"), F.coalesce("seen", F.lit(False)).alias("seen"))
    rest = entries.join(order.select(LIST).distinct(), LIST, "left_anti").select(LIST, "idx", key, "added_ms", "seen")
    return new.unionByName(rest)


def reorder_visible(entries: DataFrame, shown: DataFrame, key: str = "path") -> DataFrame:
    """shown(playlist_id, place, key) in its new order, then the entries that are not shown."""
    lists = shown.select(LIST).distinct()
    hidden = entries.join(lists, LIST, "left_semi").join(shown.select(LIST, key).distinct(), [LIST, key], "left_anti")
    both = shown.select(LIST, key, F.col("place").alias("_at"), F.lit(0).alias("_side")).unionByName(
        hidden.select(LIST, key, F.col("idx").alias("_at"), F.lit(1).alias("_side")))
    chunk = F.struct(F.col("_side"), rows_chunk("_at"))
    return repack(both, [LIST], ["_side", "_at"], chunk, "place").select(LIST, "place", key)


def mark_seen(entries: DataFrame, marks: DataFrame, key: str = "path") -> DataFrame:
    """marks(playlist_id, key): the first entry of the clip is seen."""
    hit = entries.join(marks.select(LIST, key).distinct(), [LIST, key]).groupBy(LIST, key).agg(F.min("idx").alias("idx"))
    hit = hit.select(LIST, "idx", F.lit(True).alias("_seen"))
    return entries.join(hit, [LIST, "idx"], "left").withColumn("seen", F.coalesce("_seen", "seen")).drop("_seen")


def apply_playlists(playlists: DataFrame, ops: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """ops(seq, op, playlist_id, name, description); op create / update / delete. Returns the
    playlists and the rejected operations (blank names). A created list gets the id
    pl<ms><number in hex> and no position."""
    name = text.strip(F.col("name"))
    named = F.col("op").isin("create", "update")
    blank = named & (F.coalesce(name, F.lit("")) == "")
    bad = ops.where(blank)
    good = ops.where(~blank).withColumn("name", name).withColumn("description", text.strip(F.coalesce("description", F.lit(""))))
    last = first_per_key(good.where("op = 'update'").select(LIST, "seq", "name", "description"), [F.col(LIST)], [F.col("seq")], last=True)
    last = last.select(LIST, F.col("name").alias("_name"), F.col("description").alias("_description"))
    kept = playlists.join(good.where("op = 'delete'").select(LIST).distinct(), LIST, "left_anti").join(last, LIST, "left")
    kept = kept.withColumns({"name": F.coalesce("_name", "name"), "description": F.coalesce("_description", "description")}).drop("_name", "_description")
    created = good.where("op = 'create'").select(
        F.concat(F.lit(f"pl{now_ms}"), F.lower(F.hex("seq"))).alias(LIST), "name", "description",
        F.lit(now_ms).cast("bigint").alias("created_ms"), F.lit(None).cast("bigint").alias("pos"))
    return kept.select(*created.columns).unionByName(created), bad
