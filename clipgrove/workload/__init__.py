"""Queries over the given tables, one or more per operator, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from clipgrove.fixtures import with_views

MODULES = ("catalog", "segments", "playlists", "registry", "planning", "packets", "samples", "documents", "streams")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is DuckDB text and may
    name the fx_ views."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"clipgrove.workload.{name}")
