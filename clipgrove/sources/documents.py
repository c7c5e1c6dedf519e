"""Library files and JSON index documents as tables.

Index documents are single JSON objects. Explicit schemas only; fields may be missing or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipgrove.functions import text
from clipgrove.functions.edits import legacy_mixer

# Fixed values.
CLIP_EXTS = ("mp4", "mov", "m4v", "mkv", "webm")
MAX_APP_ID = 4294967295

META = "struct<game: string, cover: string, cover_ms: bigint, derived_from: string>"
SEGMENT = ("struct<start_ms: double, end_ms: double, pos_ms: double, bound_start_ms: double, bound_end_ms: double, "
           "disabled: boolean, crop_x: double, crop_y: double>")
MIXER = ("struct<tracks: map<string, struct<vol: double, muted: boolean>>, sys_vol: double, sys_muted: boolean, "
         "mic_vol: double, mic_muted: boolean>")
LOOK = "struct<brightness: double, contrast: double, saturation: double, temperature: double, sharpness: double>"
EDIT = f"struct<segments: array<{SEGMENT}>, mixer: {MIXER}, format: struct<kind: string, fill: string, zoom: double>, look: {LOOK}>"
PLAYLIST = ("struct<id: string, name: string, created_ms: bigint, description: string, cover: string, cover_ms: bigint, "
            "pos: bigint, clips: array<variant>>")
GAME = ("struct<id: string, name: string, icon_hash: string, executables: array<struct<name: string, os: string, "
        "is_launcher: boolean, arguments: string>>, third_party_skus: array<struct<distributor: string, id: string>>>")


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that exist, asked of the file system each belongs to."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def catalog_scan(spark: SparkSession, roots: list[str], exts: tuple[str, ...] = CLIP_EXTS) -> DataFrame:
    """Clip files directly in the roots: root_no, path, name, size_bytes, modified_ms. Only file
    metadata is read. Absent roots are empty."""
    schema = "root_no int, path string, name string, size_bytes bigint, modified_ms bigint"
    there = set(present(spark, roots))
    out = spark.createDataFrame([], schema)
    for i, root in enumerate(roots):
        if root not in there:
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root)
        path = F.regexp_replace("path", "^file:/*", "/")
        part = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.coalesce(F.unix_millis("modificationTime"), F.lit(0)).alias("modified_ms"))
        out = out.unionByName(part.where(text.file_ext(F.col("path")).isin(*exts)).select(
            F.lit(i).alias("root_no"), "path", text.file_stem(F.col("path")).alias("name"), "size_bytes", "modified_ms"))
    return out


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc, value): whole texts with the file they come from; no file, no row."""
    wanted = present(spark, [paths] if isinstance(paths, str) else paths)
    if not wanted:
        return spark.createDataFrame([], "doc string, value string")
    return spark.read.text(wanted, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")


def parse(docs: DataFrame, schema: str) -> DataFrame:
    """Adds ``parsed`` of type ``schema``, null where a document does not parse."""
    boxed = f"struct<v: {schema}, _corrupt: string>"
    parsed = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), boxed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # parsers stop at the end of a value, so text behind it must break one of two wrappers; explode keeps the parse from being repeated
    valid = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull()
    both = docs.withColumn("_p", F.explode(F.array(F.when(valid, parsed))))
    return both.select(*docs.columns, F.when(F.col("_p._corrupt").isNull(), F.col("_p.v")).alias("parsed"))


def split_corrupt(docs: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents that parse as ``schema`` (doc, parsed) and those that do not (doc, value), to be
    set aside and counted as empty. Documents that come with ``parsed`` are not parsed again."""
    both = docs if "parsed" in docs.columns else parse(docs.select("doc", "value"), schema)
    return both.where("parsed IS NOT NULL").select("doc", "parsed"), both.where("parsed IS NULL").select("doc", "value")


def quarantine(bad: DataFrame, path: str) -> None:
    """Unreadable documents go to a folder of their own, never over an existing one."""
    bad.write.mode("append").parquet(path)


def overlay_rows(docs: DataFrame) -> DataFrame:
    good, _ = split_corrupt(docs, f"map<string, {META}>")
    rows = good.select("doc", F.explode("parsed").alias("path", "m"))
    return rows.select("path", "m.game", "m.cover", F.coalesce("m.cover_ms", F.lit(0)).cast("bigint").alias("cover_ms"), "m.derived_from")


def read_overlay_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return overlay_rows(read_documents(spark, path))


def edit_rows(docs: DataFrame) -> DataFrame:
    """(path, segments, mixer MAP, format, look): old scalar volumes become tracks, a missing
    format is horizontal, a missing look neutral."""
    good, _ = split_corrupt(docs, f"map<string, {EDIT}>")
    rows = good.select(F.explode("parsed").alias("path", "e"))
    m = F.col("e.mixer")
    kind = F.coalesce("e.format.kind", F.lit("horizontal"))
    look = F.struct(*[F.coalesce(F.col(f"e.look.{f}"), F.lit(0.0)).alias(f) for f in ("brightness", "contrast", "saturation", "temperature", "sharpness")])
    return rows.select(
        "path", F.coalesce("e.segments", F.expr(f"cast(array() AS array<{SEGMENT}>)")).alias("segments"),
        legacy_mixer(m["tracks"], m["sys_vol"], m["sys_muted"], m["mic_vol"], m["mic_muted"]).alias("mixer"),
        F.struct(kind.alias("kind"), F.col("e.format.fill").alias("fill"), F.col("e.format.zoom").alias("zoom")).alias("format"), look.alias("look"))


def read_edit_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return edit_rows(read_documents(spark, path))


def playlist_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists and their entries (playlist_id, idx, path, added_ms, seen). An entry is a path or
    an object; what is missing is 0 and false."""
    good, _ = split_corrupt(docs, f"array<{PLAYLIST}>")
    lists = good.select(F.explode("parsed").alias("p"))
    playlists = lists.select(
        F.col("p.id").alias("playlist_id"), "p.name", "p.created_ms", F.coalesce("p.description", F.lit("")).alias("description"),
        "p.cover", F.coalesce("p.cover_ms", F.lit(0)).cast("bigint").alias("cover_ms"), "p.pos")
    entry = lists.select(F.col("p.id").alias("playlist_id"), F.posexplode("p.clips").alias("idx", "v"))
    is_text = F.schema_of_variant("v") == "STRING"

    def field(path: str, kind: str) -> Column:
        return F.when(~is_text, F.try_variant_get("v", path, kind))

    entries = entry.select(
        "playlist_id", F.col("idx").cast("bigint").alias("idx"),
        F.when(is_text, F.try_variant_get("v", "$", "string")).otherwise(field("$.path", "string")).alias("path"),
        F.coalesce(field("$.added_ms", "bigint"), F.lit(0)).cast("bigint").alias("added_ms"), F.coalesce(field("$.seen", "boolean"), F.lit(False)).alias("seen"))
    return playlists, entries


def read_playlist_index(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return playlist_rows(read_documents(spark, path))


def registry_tables(games: DataFrame) -> dict[str, DataFrame]:
    """games(idx, g): the tables game, game_exe and game_sku; steam id as a 32-bit number or NULL,
    the first entry per store."""
    sku = F.coalesce("g.third_party_skus", F.expr("cast(array() AS array<struct<distributor: string, id: string>>)"))

    def first(store: str) -> Column:
        return F.try_element_at(F.filter(sku, lambda s: s["distributor"] == store), F.lit(1))["id"]

    steam = F.when(first("steam").rlike(r"^\+?[0-9]+$"), first("steam").try_cast("bigint"))
    game = games.select(
        "idx", F.coalesce("g.id", F.lit("")).alias("id"), "g.name", F.lower(text.strip(F.col("g.name"))).alias("lower"), "g.icon_hash",
        F.when(steam <= MAX_APP_ID, steam).alias("steam_appid"), first("xbox").alias("xbox_sku"))
    exe = games.select("idx", F.col("g.name").alias("name"), F.posexplode("g.executables").alias("exe_no", "e"))
    skus = games.select("idx", F.posexplode(sku).alias("sku_no", "s"))
    return {
        "game": game,
        "game_exe": exe.select(
            "idx", "name", "exe_no", F.col("e.name").alias("exe"), F.coalesce("e.os", F.lit("")).alias("os"),
            F.coalesce("e.is_launcher", F.lit(False)).alias("is_launcher"), "e.arguments"),
        "game_sku": skus.select("idx", "sku_no", "s.distributor", "s.id"),
    }


def read_registry(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    good, _ = split_corrupt(read_documents(spark, path), f"array<{GAME}>")
    return registry_tables(good.select(F.posexplode("parsed").alias("idx", "g")))
