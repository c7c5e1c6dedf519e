"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from clipgrove import workload
from clipgrove.fixtures import TABLES

SF = "/root/testdata/sf0.001"
workload.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    picked = [tuple(r[i] for i in at) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = workload.QUERIES[name](spark, SF)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    assert name in workload.SQL
    res = con.sql(workload.SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert got == ordered(res.fetchall(), res.columns)
