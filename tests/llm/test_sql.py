"""Queries that SQL can say, against DuckDB."""

import pytest

pytest.importorskip("weft.llm.queries")
from weft.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (sorted(map(str, x[cols].itertuples(index=False, name=None))) for x in (got, want))
    assert a == b
