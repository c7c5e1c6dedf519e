"""Tables that sinks change batch by batch, so that a batch which fails half way and is repeated counts once.

Data lies in folders of its own per batch. A version is one small file that names the live folders and the batch it is the
state after; it is written aside and renamed, so it is there whole or not at all, and readers see the newest one. One
writer at a time, with rising batch numbers, as ``foreachBatch`` calls its function.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

KEPT = 2


class Versions:
    """The versions below ``path``; ``state``: what the newest holds, ``{"batch": n, ...}``, or None."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._of(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._of(f"{self.path}/_versions/{name}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit()]

    @property
    def state(self) -> dict | None:
        found = self.numbers()
        return self._read(f"{max(found):020d}.json") if found else None

    def commit(self, state: dict) -> None:
        """Makes ``state`` the newest version and drops folders that neither it nor the one before names."""
        number = max(self.numbers(), default=-1) + 1
        aside, place = self._of(f"{self.path}/_versions/_new"), self._of(f"{self.path}/_versions/{number:020d}.json")
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not self.fs.rename(aside, place):
            raise OSError(f"{place.toString()} could not be written")
        self._clean()

    def _clean(self) -> None:
        found = self.numbers()
        for old in found[:-KEPT]:
            self.fs.delete(self._of(f"{self.path}/_versions/{old:020d}.json"), False)
        named = {f for n in found[-KEPT:] for f in self._read(f"{n:020d}.json")["live"]}
        for batch in self._names(f"{self.path}/data"):
            inner = [n for n in self._names(f"{self.path}/data/{batch}") if "=" in n]
            if not any(f == batch or f.startswith(f"{batch}/") for f in named):
                self.fs.delete(self._of(f"{self.path}/data/{batch}"), True)
            elif batch not in named:
                for n in inner:
                    if f"{batch}/{n}" not in named:
                        self.fs.delete(self._of(f"{self.path}/data/{batch}/{n}"), True)

    def folder(self, name: str) -> str:
        return f"{self.path}/data/{name}"


class KeyedTable:
    """A table with one row per key, in ``buckets`` of the hash of its ``keys``. A batch rewrites the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.versions, self.spark, self.schema, self.keys, self.buckets = Versions(spark, path), spark, schema, keys, buckets

    def _live(self, state: dict | None, only: set[int] | None = None) -> DataFrame:
        live = [self.versions.folder(f) for f in (state or {"live": []})["live"] if only is None or int(f.rpartition("=")[2]) in only]
        return self.spark.read.schema(self.schema).parquet(*live) if live else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._live(self.versions.state)

    def merge(self, number: int, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replaces the rows of the touched buckets by ``fold(their rows, batch)``. A batch number that is not above the last one
        was there before and changes nothing. Keys must not change their hash in ``fold``."""
        state = self.versions.state
        if state and number <= state["batch"]:
            return False
        bucket = lambda df: F.pmod(F.xxhash64(*[df[k] for k in self.keys]), F.lit(self.buckets)).cast("int")
        batch = batch.withColumn("_bucket", bucket(batch))
        touched = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
        new = fold(self._live(state, touched), batch.drop("_bucket"))
        new.withColumn("bucket", bucket(new)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.versions.folder(f"b{number}"))
        there = {int(n.rpartition("=")[2]) for n in self.versions._names(self.versions.folder(f"b{number}")) if n.startswith("bucket=")}
        kept = [f for f in (state or {"live": []})["live"] if int(f.rpartition("=")[2]) not in touched]
        self.versions.commit({"batch": number, "live": kept + [f"b{number}/bucket={b}" for b in sorted(there)]})
        return True
