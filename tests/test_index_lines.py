"""Lines by arrays against the lines of the index."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tests.test_catalog import SF
from weft import catalog
from weft.functions.text import terms_of
from weft.operators.index import build_index
from weft.sources import index_lines
from weft.sources.index_text import global_lines

ROWS = [
    (5, "alpha beta alpha beta gamma, alpha beta"),
    (40, "alpha beta gamma"),
    (40, "alpha delta. Beta"),
    (None, "alpha beta"),
    (None, "beta"),
    (7, None),
    (8, " 12 the "),
    (9, "alpha"),
    (10, "alpha beta alpha beta gamma, alpha beta"),
    (11, "Été alpha"),
]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_the_same_lines(spark, kind):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").repartition(3)
    got, want = index_lines.lines_of(docs), global_lines(build_index(docs), "doc_id")
    assert got.dtypes == want.select("term", "line").dtypes
    assert sorted(got.collect()) == sorted(want.select("term", "line").collect())
    assert index_lines.lines_of(docs.limit(0)).count() == 0


def test_slices_of_few_words_and_postings(monkeypatch):
    """The kernels, however many slices, tasks and batches there are."""
    r = np.random.default_rng(3)
    docs = [(str(d), [f"w{'abcdef'[int(x)]}" for x in r.integers(0, 6, int(r.integers(0, 30)))]) for d in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([w for _, w in docs], pa.list_(pa.string()))], names=["doc", "words"])

    def lines(tasks, batches):
        sent = pa.Table.from_batches(list(index_lines._dealt(tasks)(batches)))
        out = []
        for t in range(tasks):
            own = sent.filter(pa.compute.equal(sent["task"], t))
            out += [tuple(x.values()) for b in index_lines._lines(own.to_batches(max_chunksize=3)) for x in b.to_pylist()]
        return out

    counts = {}
    for d, w in docs:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                own = counts.setdefault(" ".join(w[i : i + n]), {})
                own[d] = own.get(d, 0) + 1
    want = sorted((t, f"{t} | " + " ".join(f"{d} {c}" for d, c in sorted(of.items(), key=lambda x: (-x[1], x[0])))) for t, of in counts.items())
    assert sorted(lines(1, [batch])) == want
    monkeypatch.setattr(index_lines, "WORDS", 50)
    monkeypatch.setattr(index_lines, "POSTINGS", 7)
    assert sorted(lines(5, [batch.slice(0, 33), batch.slice(33)])) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_row_for_an_n_gram(spark):
    out = catalog.QUERIES["index_text_lines"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    row = next(x for x in out.take(1))
    assert terms_of(row.term, ()) and row.line.startswith(f"{row.term} | ")
