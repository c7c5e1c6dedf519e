"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clipgrove.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of stars: every node sends its (larger, or smaller) neighbours to its smallest one.
    Minima are partial aggregates and the join splits hot nodes, so no neighbourhood meets in one task."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v; any order, repeats and loops allowed) to (id, component_id): the smallest id
    reachable. Nodes without an edge to another node do not appear. Alternating large and small stars:
    a logarithmic number of rounds in practice, each written to the checkpoint folder. Nulls are ignored."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        e = cut(_star(_star(e, True), False))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
