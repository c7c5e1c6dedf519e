"""Every llm query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from clipgrove.fixtures import TABLES
from clipgrove.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    want = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    pick = lambda rows, names: sorted((tuple(r[names.index(c)] for c in cols) for r in rows), key=str)
    assert pick([tuple(r) for r in df.collect()], df.columns) == pick(want.fetchall(), list(want.columns))
