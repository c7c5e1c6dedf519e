"""Game registry: usable executables, owners, look-ups, ranked search, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.functions import text
from clipgrove.operators.scan import Run, first_per_key, rows_chunk, running

# Fixed values.
GENERIC_EXES = ("javaw.exe", "java.exe", "python.exe", "pythonw.exe")
GAME_CLIENTS = ("leagueclientux.exe",)
PATH_HINTS = (
    "minecraft", "lunarclient", "badlion", "feather", "labymod", "tlauncher",
    "prismlauncher", "multimc", "modrinth", "salwyrr", "pojav",
)
HINT_GAME = "Minecraft"
LIBRARY_MARKER = "/steamapps/common/"
SEARCH_LIMIT = 12


def name_key(name: Column) -> Column:
    return F.lower(text.strip(name))


def usable_executables(df: DataFrame) -> DataFrame:
    """Adds ``base``; drops launchers (but for clients), entries with arguments, other systems,
    other file kinds and shared runtimes."""
    base = text.exe_basename(F.col("exe"))
    launcher = F.col("is_launcher") & ~base.isin(*GAME_CLIENTS)
    return df.withColumn("base", base).where(
        ~launcher & F.col("arguments").isNull() & F.coalesce("os", F.lit("")).isin("", "win32")
        & base.endswith(".exe") & ~base.isin(*GENERIC_EXES))


def exclusive_owner(df: DataFrame, key: str = "base", owner: str = "name") -> DataFrame:
    """Keys that belong to one distinct owner, with the icon of its first entry."""
    return (
        df.groupBy(key).agg(
            F.min(owner).alias(owner), F.max(owner).alias("_other"),
            F.min_by(F.struct("icon"), "idx").alias("_first"))
        .where(F.col(owner) == F.col("_other")).select(key, owner, F.col("_first.icon").alias("icon"))
    )


def icon_url(game_id: Column, icon_hash: Column, base_url: str) -> Column:
    ok = (F.coalesce(game_id, F.lit("")) != "") & icon_hash.isNotNull()
    return F.when(ok, F.concat(F.lit(base_url), game_id, F.lit("/"), icon_hash, F.lit(".png")))


def name_index(registry: DataFrame) -> DataFrame:
    """First entry per name, ignoring case."""
    return first_per_key(registry, [name_key(F.col("name"))], [F.col("idx")])


def registry_lookup(df: DataFrame, registry: DataFrame, base_url: str, name: str = "name") -> DataFrame:
    """Adds icon_url, steam_appid and xbox_sku of the first registry entry of that name."""
    r = name_index(registry).select(
        name_key(F.col("name")).alias("_key"), icon_url(F.col("id"), F.col("icon_hash"), base_url).alias("icon_url"), "steam_appid", "xbox_sku")
    return df.withColumn("_key", name_key(F.col(name))).join(r, "_key", "left").drop("_key")


def exe_lookup(procs: DataFrame, owners: DataFrame) -> DataFrame:
    return procs.join(owners.withColumnRenamed("base", "exe"), "exe")


def rank_names(df: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Tier 0 equal, 1 prefix, 2 prefix of a word, 3 anywhere; by tier, then name."""
    q = query.strip().lower()
    lower = name_key(F.col("name"))
    words = F.split(F.col("lower"), r"[^\p{L}\p{N}]+")
    tier = (
        F.when(F.col("lower") == q, 0).when(F.startswith(F.col("lower"), F.lit(q)), 1)
        .when(F.exists(words, lambda w: F.startswith(w, F.lit(q))), 2).when(F.contains(F.col("lower"), F.lit(q)), 3)
    )
    hits = df.withColumn("lower", lower).withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(q != ""))
    return first_per_key(hits, [F.col("lower")], [F.col("idx")]).orderBy("tier", "lower").limit(limit).select("name", F.col("tier").cast("bigint").alias("tier"))


def pick_game(hits: DataFrame, key: str = "query") -> DataFrame:
    """hits(query, wanted, idx, id, name, steam, has_types): among exact names the best platform
    (the last of equals), else the first hit."""
    exact = F.lower("name") == F.lower("wanted")

    def rank(c):
        return F.when(exact, -c.cast("bigint")).otherwise(0)

    order = [F.when(exact, 0).otherwise(1), rank(F.col("steam")), rank(F.col("has_types")),
             F.when(exact, -F.col("idx")).otherwise(F.col("idx"))]
    return first_per_key(hits, [F.col(key)], order)


def manifest_join(procs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Library game by the folder of the process path: manifests(lib_root, installdir, name,
    appid, file). The first manifest of a folder counts, ignoring case."""
    path = F.col("path")
    at = F.instr(path, LIBRARY_MARKER)
    found = at > 0
    root = F.concat(F.substring(path, F.lit(1), at - 1), F.lit("/steamapps"))
    folder = F.split_part(F.substring(path, at + len(LIBRARY_MARKER), F.length(path)), F.lit("/"), F.lit(1))
    first = first_per_key(manifests, [F.col("lib_root"), F.lower("installdir")], [F.col("file")])
    title = text.strip(F.translate(F.coalesce("name", "installdir"), "™®©", ""))
    m = first.select(
        F.col("lib_root").alias("_root"), F.lower("installdir").alias("_dir"), title.alias("game"),
        F.col("appid").try_cast("bigint").alias("appid")).where("appid IS NOT NULL")
    p = procs.withColumn("_root", F.when(found, root)).withColumn("_dir", F.when(found & (folder != ""), F.lower(folder)))
    return p.join(m, ["_root", "_dir"], "left").drop("_root", "_dir")


def detect(procs: DataFrame, owners: DataFrame, manifests: DataFrame, keys: list[str], hints=PATH_HINTS) -> DataFrame:
    """procs(<keys>, pid, exe, path), one snapshot per ``keys``: library folder, else own
    executable, else a shared runtime whose own path, or that of any other process of the
    snapshot, shows a hint."""
    path = F.col("path")
    hinted = text.any_of([F.contains(path, F.lit(h)) for h in hints])
    p = procs.withColumn("_hint", F.coalesce(hinted, F.lit(False)))
    some = p.groupBy(*keys).agg(F.count_if("_hint").alias("_hints"))
    by_store = manifest_join(p, manifests).withColumnRenamed("game", "_store").drop("appid")
    o = owners.select(F.col("base").alias("exe"), F.col("name").alias("_owner"))
    out = by_store.join(o, "exe", "left").join(some, keys)
    other = F.col("_hints") > F.when(F.col("_hint"), 1).otherwise(0)
    by_hint = F.when(F.col("exe").isin(*GENERIC_EXES) & (F.col("_hint") | other), F.lit(HINT_GAME))
    how = F.when(F.col("_store").isNotNull(), "store").when(F.col("_owner").isNotNull(), "exe").when(by_hint.isNotNull(), "hint")
    return out.withColumn("game", F.coalesce("_store", "_owner", by_hint)).withColumn("how", how).select(*procs.columns, "game", "how")


def keep_last(seen: DataFrame, ends: DataFrame, keys: list[str] = ["session"]) -> DataFrame:
    """seen(session, seq, pid, game): with no game in front the last one stays while its process
    lives; ends(<keys>, pid, end_seq) tells when processes ended. A pid means something only within ``keys``."""
    e = ends.select(*keys, "pid", "end_seq")
    tagged = seen.join(e, [*keys, "pid"], "left")
    mark = F.when(F.col("game").isNotNull(), F.struct("game", "end_seq"))
    out = running(tagged, ["session"], ["seq"], {"_last": Run("last", mark)}, rows_chunk("seq"))
    alive = F.col("_last.end_seq").isNull() | (F.col("_last.end_seq") > F.col("seq"))
    return out.withColumn("current", F.when(F.col("game").isNotNull(), F.col("game")).when(alive, F.col("_last.game"))).select(
        *seen.columns, "current")
