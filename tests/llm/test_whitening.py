import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm.whitening")
from weft.llm import doubles, whitening
from weft.llm.eigen import divide, eigen
from weft.llm.queries import QUERIES


def plain(vectors):
    """(n, sums, covariance, eigenvalues, eigenvectors) of the distinct x vectors, in integers as far as they go."""
    x = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors}), object)
    n, sums = len(x), x.sum(0)
    t = n * x - sums
    cov = np.array([[float(Fraction(int(v), n**3)) for v in r] for r in t.T @ t])
    w, u = np.linalg.eigh(cov)
    return n, sums, cov, w[::-1], u[:, ::-1]


def test_query_against_integers(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, cov, w, u = plain([r.embedding for r in rows])
    x = {r.vec_id: [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows}
    got = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(got) == 16 * len(rows)
    sign = {}
    for r in got:
        t = [n * a - int(s) for a, s in zip(x[r.vec_id], sums)]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, sum(v * v for v in t))
        want = sum(float(Fraction(v, n)) * u[i, k] for i, v in enumerate(t)) / math.sqrt(w[k])
        s = sign.setdefault(k, 1 if want * r.whitened >= 0 else -1)
        assert abs(r.whitened - s * want) < 1e-8 * (1 + abs(want))
        assert abs(r.explained - w[k] / np.trace(cov)) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_awkward_rows(spark):
    a, b = [0.5, 1.0], [0.25, -3.0]
    rows = [(1, a), (1, a), (None, b), (2, [9.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [1.001]), (10, [1e300, 0.0]), (11, [0.5, 1.0000001])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, n int").withColumn("whitened", F.lit("x"))
    got = whitening.whiten(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(map(str, [1, 1, None, 2, 11, 8, 9]))
    n, sums, cov, w, _ = plain([a, b, [9.0, 2.0]])
    two = [r for r in got if len(r.whitened) == 2]
    assert {r.n for r in two} == {3} and len({tuple(r.whitened) for r in two if r.vec_id in (1, 11)}) == 1
    assert np.allclose(two[0].explained, w / np.trace(cov)) and two[0].identity_error < 1e-12
    one = [r for r in got if len(r.whitened) == 1]
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, [None], [None])] * 2
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0


def test_large_entries_and_few_vectors(spark):
    rows = [(i, [c * 2.0**40, c, 1.0]) for i, c in enumerate([0.0, 1.0, 3.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    n, sums, *_ = plain([r[1] for r in rows])
    for i, v in rows:
        d = sum((n * (math.floor(64 * c) + 1_000_000) - int(s)) ** 2 for c, s in zip(v, sums))
        assert got[i].deviation == (d if d < 2**63 else None)
        assert got[i].whitened[0] is not None and got[i].whitened[2] is None and got[i].explained[2] == 0


def test_packing_gives_the_vectors_back():
    import pyarrow as pa

    vectors = [[c] * 3 for c in (0.0, -2.0, 1.984375, 2.0, -2.000001, 511.99, -512.0, -513.0, 2.0**24, -(2.0**25), 2.0**30, 2.0**50)]
    batch = pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64()))], names=["vec"])
    blobs = next(whitening._pack(iter([batch]))).column(0)
    got = {tuple(r) for x in whitening._unpacked(blobs) for r in x.tolist()}
    assert got == {tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}
    assert {b.as_py()[0] for b in blobs} == {1, 2, 4, 8}


def test_copies_and_tasks_change_nothing(spark, sf):
    """A third of all rows one vector, over one task or many: the same model, to the last bit where sums are exact."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    hot = df.limit(1).select(F.explode(F.sequence(F.lit(-300).cast("bigint"), F.lit(-1).cast("bigint"))).alias("vec_id"), "vec")
    a = whitening.fit(df.select("vec").coalesce(1))[64]
    b = whitening.fit(df.unionByName(hot).select("vec").repartition(13))[64]
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.values, b.values, rtol=1e-14)
    assert np.allclose(np.abs((a.vectors * b.vectors).sum(0)), 1, atol=1e-13)


def test_products_are_exact_far_beyond_doubles():
    r = np.random.default_rng(5)
    a, b = r.normal(size=(3, 3000)) * 10.0 ** r.integers(-3, 3, (3, 3000)), r.normal(size=(3000, 2))
    high, low = doubles.product(doubles.exact(a), doubles.exact(b))
    for i in range(3):
        for j in range(2):
            want = sum(Fraction(x) * Fraction(y) for x, y in zip(a[i].tolist(), b[:, j].tolist()))
            size = sum(abs(x * y) for x, y in zip(a[i].tolist(), b[:, j].tolist()))
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) < size * 1e-17


def test_eigenvectors():
    r = np.random.default_rng(1)
    turn = np.linalg.qr(r.normal(size=(40, 40)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    some = r.normal(size=(64, 90))
    for a in (some @ some.T, wilkinson, np.eye(7), np.zeros((5, 5)), np.ones((20, 20)), (turn * np.repeat([1.0, 1e-6, 1e3, 5.0], 10)) @ turn.T, np.array([[3.0]]), -some[:30] @ some[:30].T * 1e100):
        a = (a + a.T) / 2
        w, x = eigen(doubles.exact(a))
        size = np.abs(w).max() or 1.0
        assert np.all(np.diff(w) <= 0) and np.allclose(w, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-14 * size)
        assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-12 and np.abs(a @ x - x * w).max() < 1e-13 * size


def test_divide_and_conquer_by_itself():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 33):
        d, e = r.normal(size=n), r.normal(size=max(0, n - 1))
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        w, x = divide(d, e)
        assert np.allclose(w, np.linalg.eigvalsh(t), atol=1e-13) and np.abs(t @ x - x * w).max() < 1e-12
