import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from clipgrove.session import local_session

    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """frame(schema, rows) -> DataFrame"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def rows(df, *cols):
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))
