import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, repeated texts, columns with names that operators use themselves."""
    rows = [(1, None, "a", 1.0), (2, "", None, 2.0), (3, " \n\t ", "a", 3.0), (4, "one", "b", 4.0), (5, "one", "b", 5.0),
            (6, "w x y z " * 9000, "a", 6.0), (7, None, None, None), (8, "é ü 日本語 \U0001f600 tail.", "c", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double").selectExpr(
        "*", "'en' as lang", "1L as n_chars", "7L as id", "'k' as key", "9L as slot", "1 as at", "2 as n", "'x' as _old", "3L as position")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
