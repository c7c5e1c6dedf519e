"""Cache files: usage per kind and age."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values.
DAY_MS = 24 * 3600 * 1000
SHARE_AGE_MS, CACHE_AGE_MS = DAY_MS, 7 * DAY_MS


def usage(files: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds(kind): bytes per kind, zero kinds too, and the total as kind NULL."""
    per = kinds.select("kind").join(files.groupBy("kind").agg(F.sum("bytes").alias("_b")), "kind", "left").select(
        "kind", F.coalesce("_b", F.lit(0)).cast("bigint").alias("bytes"))
    return per.rollup("kind").agg(F.sum("bytes").alias("bytes"))


def stale(files: DataFrame, now_ms: int, max_age_ms: int = CACHE_AGE_MS) -> DataFrame:
    """Files older than ``max_age_ms``; an unknown time is not old."""
    return files.where(F.lit(now_ms) - F.col("mtime_ms") > max_age_ms)
