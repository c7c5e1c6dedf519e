"""Packet tables, read once or followed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

PACKETS = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("track", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("time", T.LongType()), T.StructField("dur", T.LongType()),
    T.StructField("key", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("width", T.LongType()),
])


def packets(spark: SparkSession, path: str, streaming: bool = False, schema: T.StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet packets. A stream needs a schema up front: the packet schema unless given."""
    if not streaming:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.readStream.schema(schema or PACKETS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
