import os

import duckdb
import pytest

SF = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
LONG = "b " * 30_000


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def db(sf):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, "alpha beta gamma " * 40, "en", "s", 1), (2, "alpha beta gamma " * 40, "en", None, 2), (2, "alpha beta gamma " * 40, "en", None, 2), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \t\n", "en", "s", 3),
        (6, LONG, "en", "s", 4), (7, LONG + "c", "de", "s", 4), (None, "alpha beta gamma " * 40, "de", "s", 5), (8, "ÄÖÜ straße 日本 " * 30, "de", "s", 6), (9, "12 34 --", "en", "s", 7), (2, "another text under the same id", "en", "s", 8),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, h bigint")


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)
