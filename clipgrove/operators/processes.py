"""Process trees: capture roots, session owners, merged audio sessions.

Ancestors are found by pointer doubling: after round k every process knows what lies within
2^k parents, so 64 parents take six equi joins. Each round is checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.operators.scan import first_per_key
from clipgrove.session import cut

# Fixed values.
HOPS_LOG2 = 6
WEBVIEW = "msedgewebview2.exe"


def _ancestors(procs: DataFrame, hit: Column, keys: list[str]) -> DataFrame:
    """(<keys>, pid, near): pid of the nearest proper ancestor for which ``hit`` holds, within the hop
    limit. ``hit`` is a boolean over procs. The limit of 64 hops is the rule of the operator: what lies above it in a deeper tree
    is not seen."""
    flags = procs.select(*keys, F.col("pid").alias("up"), hit.alias("_flag"))
    state = procs.select(*keys, "pid", F.when(F.col("parent") != 0, F.col("parent")).alias("up")).join(flags, [*keys, "up"], "left")
    state = cut(state.select(*keys, "pid", "up", F.when(F.col("_flag"), F.col("up")).alias("near")))
    for _ in range(HOPS_LOG2):
        if state.where("near IS NULL AND up IS NOT NULL AND up <> pid").isEmpty():
            break
        above = state.select(*keys, F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("near").alias("_near"))
        state = cut(state.join(above, [*keys, "up"], "left").select(*keys, "pid", F.col("_up").alias("up"), F.coalesce("near", "_near").alias("near")))
    return state.select(*keys, "pid", "near")


def _given(procs: DataFrame, keys: list[str], pid: int | DataFrame) -> DataFrame:
    """(<keys>, pid): one process for all, or a row per machine."""
    return procs.where(F.col("pid") == pid).select(*keys, "pid") if isinstance(pid, int) else pid.select(*keys, "pid").distinct()


def process_roots(procs: DataFrame, slots: list[str | None], game: int | DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """procs(<keys>, pid, parent, exe) -> (<keys>, pid, slot); ``keys`` name the snapshot (machine, time) within which pids are unique.
    ``slots`` lists wanted executables, None is the slot of the game process: a pid, or a table (<keys>, pid). A target
    below another target goes."""
    exes = F.array(*[F.lit(s) for s in slots])
    slot = F.array_position(exes, F.col("exe")).cast("bigint") - 1
    parent = procs.select(*keys, F.col("pid").alias("parent"), F.col("exe").alias("_pexe"))
    roots = procs.join(parent, [*keys, "parent"], "left").where(
        (slot >= 0) & (F.col("_pexe").isNull() | (F.col("_pexe") != F.col("exe")))).select(*keys, "pid", slot.alias("slot"))
    if game is not None and None in slots:
        own = procs.join(_given(procs, keys, game), [*keys, "pid"], "left_semi").select(*keys, "pid", F.lit(slots.index(None)).cast("bigint").alias("slot"))
        both = roots.withColumn("_p", F.lit(1)).unionByName(own.withColumn("_p", F.lit(0)))
        roots = first_per_key(both, [F.col(k) for k in [*keys, "pid"]], [F.col("_p")]).drop("_p")
    roots = cut(roots)
    marked = procs.join(roots.select(*keys, "pid", F.lit(True).alias("_cand")), [*keys, "pid"], "left")
    near = _ancestors(marked, F.coalesce("_cand", F.lit(False)), keys)
    covered = F.col("near").isNotNull() & (F.col("near") != F.col("pid"))
    return roots.join(near, [*keys, "pid"]).where(~covered).select(*keys, "pid", "slot").orderBy(*keys, "pid", "slot")


def session_owner(procs: DataFrame, own: int | DataFrame, keys: list[str] = []) -> DataFrame:
    """(<keys>, pid, owner): web view processes belong to the first other process above them; NULL in
    the tree of ``own``, a pid or a table (<keys>, pid)."""
    procs = procs.join(_given(procs, keys, own).withColumn("_own", F.lit(True)), [*keys, "pid"], "left")
    mine = F.coalesce("_own", F.lit(False))
    near = _ancestors(procs, mine, keys)
    web = F.col("exe") == WEBVIEW
    jump = cut(procs.select(*keys, "pid", F.when(web, F.col("parent")).otherwise(F.col("pid")).alias("owner"), mine.alias("_own")))
    for _ in range(HOPS_LOG2):
        above = jump.where("owner <> pid").select(*keys, F.col("pid").alias("owner"), F.col("owner").alias("_next"))
        stepped = cut(jump.join(above, [*keys, "owner"], "left").select(
            *keys, "pid", F.coalesce("_next", "owner").alias("owner"), "_own", F.col("_next").isNotNull().alias("_moved")))
        jump = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            break
    inside = F.col("_own") | F.col("near").isNotNull()
    return jump.join(near, [*keys, "pid"]).select(*keys, "pid", F.when(~inside, F.col("owner")).alias("owner"))


def merge_sessions(df: DataFrame) -> DataFrame:
    """df(exe, active, name, idx): one row per program, active if any session is, the first
    description; active ones first."""
    out = df.groupBy(F.lower("exe").alias("key")).agg(
        F.bool_or("active").alias("active"), F.min_by(F.struct("exe", "name"), "idx").alias("_d"))
    return out.select("key", "active", "_d.exe", "_d.name").orderBy(F.col("active").desc(), F.lower("name"))
