"""Rows from ranges of numbers, however long one range is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 1 << 16


def expand(df: DataFrame, first: Column, last: Column, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` once per number from ``first`` to ``last``, which is the column ``out``. A range is cut into blocks of ``block`` numbers; the blocks are
    dealt over all tasks and then written out, so one range of any length is the work of many tasks. Empty ranges
    and null ends give no row."""
    low, high = first.cast("bigint"), last.cast("bigint")
    cut = df.withColumn("_last", high).withColumn("_first", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(block).cast("bigint")))))
    names = [c for c in df.columns if c != out]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few small blocks would be put together again
    dealt = cut.select(*names, "_first", F.least(F.col("_first") + (block - 1), F.col("_last")).alias("_last")).repartition(parts, "_first", *names)
    return dealt.select(*names, F.explode(F.sequence("_first", "_last")).alias(out))
