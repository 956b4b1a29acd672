"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weft import catalog

SF = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, db, name, query, sql):
    got, want = query(spark, SF).toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (sorted(map(str, x[cols].itertuples(index=False, name=None))) for x in (got, want))
    assert a == b, name


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    if name in catalog.ORACLE:
        compare(spark, db, name, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
