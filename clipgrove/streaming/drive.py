"""Feeds a table to a streaming query in arrival steps and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clipgrove.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _few_partitions(spark: SparkSession, most: int = 8):
    """On one machine every state partition is a Python worker; a cluster keeps its setting."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    if spark.sparkContext.master.startswith("local") and int(old) > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def run_steps(rows: DataFrame, step: str, steps: int, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Writes the rows of one ``step`` value after the other and runs the query on each until it is
    done; the query goes on from its checkpoint, as after a restart. Steps hold any number of files."""
    spark = rows.sparkSession
    root = scratch(spark, name)
    data = rows.drop(step)

    def stream() -> DataFrame:
        return spark.readStream.schema(data.schema).parquet(f"{root}/in")

    spark.createDataFrame([], data.schema).write.parquet(f"{root}/in")
    for i in range(steps):
        rows.where(f"{step} = {i}").drop(step).write.mode("append").parquet(f"{root}/in")
        with _few_partitions(spark):
            sink = build(stream()).writeStream.format("parquet").option("path", f"{root}/out")
            sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def run_sink(rows: DataFrame, step: str, steps: int, sink: Callable[[DataFrame, str, str], object], name: str) -> str:
    """Same for ``foreachBatch`` sinks sink(stream, path, checkpoint); returns the path."""
    spark = rows.sparkSession
    root = scratch(spark, name)
    data = rows.drop(step)
    spark.createDataFrame([], data.schema).write.parquet(f"{root}/in")
    for i in range(steps):
        rows.where(f"{step} = {i}").drop(step).write.mode("append").parquet(f"{root}/in")
        df = spark.readStream.schema(data.schema).parquet(f"{root}/in")
        with _few_partitions(spark):
            sink(df, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/out"
