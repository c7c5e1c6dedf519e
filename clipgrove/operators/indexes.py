"""Keyed indexes of edits and overlay rows: moves, removals, lineage, batches of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.functions import text
from clipgrove.operators.playlists import LIST, remove_entries
from clipgrove.operators.scan import first_per_key

# Files that go along with a clip.
SIDECARS = ("clip.json", "edit.json")


def prune_empty(meta: DataFrame) -> DataFrame:
    """Overlay rows without label, cover and origin disappear."""
    return meta.where("game IS NOT NULL OR cover IS NOT NULL OR derived_from IS NOT NULL")


# --- paths that change or go -----------------------------------------------------------

def rekey_index(index: DataFrame, mapping: DataFrame, key: str = "path") -> DataFrame:
    """mapping(old, new): rows move to the new key; a moved row replaces one that is there."""
    m = mapping.select(F.col("old").alias(key), "new")
    moved = index.join(m, key).withColumn(key, F.col("new")).select(*index.columns)
    stay = index.join(m.select(key), key, "left_anti").join(moved.select(key), key, "left_anti")
    return stay.select(*index.columns).unionByName(moved)


def rekey_values(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def rekey(edits: DataFrame, meta: DataFrame, entries: DataFrame, mapping: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """A path change through edits, overlay keys and origins, and playlist entries."""
    return {
        "edits": rekey_index(edits, mapping, key),
        "meta": rekey_values(rekey_index(meta, mapping, key), mapping, "derived_from"),
        "entries": rekey_values(entries, mapping, key),
    }


def forget(edits: DataFrame, meta: DataFrame, entries: DataFrame, gone: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """Deleted clips leave edits, overlay and every playlist."""
    paths = gone.select(key).distinct()
    return {
        "edits": edits.join(paths, key, "left_anti"),
        "meta": meta.join(paths, key, "left_anti"),
        "entries": remove_entries(entries, paths, key),
    }


def sidecar_files(gone: DataFrame) -> DataFrame:
    """The clip and its sidecar paths, to be deleted together."""
    path = F.col("path")
    base = F.concat(text.folder(path), F.lit("/"), text.file_stem(path), F.lit("."))
    return gone.select(F.explode(F.array(path, *[F.concat(base, F.lit(s)) for s in SIDECARS])).alias("path"))


def forget_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(sidecar_files(gone).distinct(), "path", "left_anti")


def inherit(meta: DataFrame, exports: DataFrame, now_ms: int, key: str = "path") -> DataFrame:
    """exports(child, parent): the child always records its origin; with an overlay row of the
    parent it takes the label, and the cover if there is one."""
    parent = meta.select(F.col(key).alias("parent"), F.col("game").alias("_game"), F.col("cover").alias("_cover"), F.lit(True).alias("_has"))
    new = exports.join(parent, "parent", "left").select(F.col("child").alias(key), F.col("parent").alias("_from"), "_game", "_cover", "_has")
    out = meta.join(new, key, "full_outer")
    has_cover = F.col("_cover").isNotNull()
    return prune_empty(out.select(
        key, F.when(F.col("_has"), F.col("_game")).otherwise(F.col("game")).alias("game"),
        F.coalesce("_cover", "cover").alias("cover"),
        F.when(has_cover, F.lit(now_ms)).otherwise(F.coalesce("cover_ms", F.lit(0))).cast("bigint").alias("cover_ms"),
        F.coalesce("_from", "derived_from").alias("derived_from")))


# --- batches ---------------------------------------------------------------------------

def apply_edits(index: DataFrame, batch: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """batch(key, seq, noop, ... columns of index): the latest edit of a key counts; a no-op
    deletes. Returns the index and (key, edited) for the keys of the batch."""
    last = first_per_key(batch, [F.col(key)], [F.col("seq")], last=True)
    rest = index.join(last.select(key), key, "left_anti")
    out = rest.select(*index.columns).unionByName(last.where("NOT noop").select(*index.columns))
    return out, last.select(key, (~F.col("noop")).alias("edited"))


def apply_overlay(meta: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """batch(key, seq, op, value, stamp); op set_game (blank = back to the detected one),
    set_cover, clear_cover. The latest operation per field counts."""
    def last(cond: Column) -> Column:
        return F.max_by(F.struct("op", "value", "stamp"), F.when(cond, F.col("seq")))

    is_game = F.col("op") == "set_game"
    ops = batch.groupBy(key).agg(last(is_game).alias("_g"), last(~is_game).alias("_c"))
    out = meta.join(ops, key, "full_outer")
    g, c = F.col("_g"), F.col("_c")
    set_cover = c["op"] == "set_cover"
    return prune_empty(out.select(
        key, F.when(g.isNotNull(), text.blank_to_null(g["value"])).otherwise(F.col("game")).alias("game"),
        F.when(c.isNull(), F.col("cover")).when(set_cover, c["value"]).alias("cover"),
        F.coalesce(F.when(c.isNull(), F.col("cover_ms")).when(set_cover, c["stamp"]), F.lit(0)).cast("bigint").alias("cover_ms"),
        "derived_from"))
