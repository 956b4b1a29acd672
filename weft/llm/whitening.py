"""Embedding whitening: compensated covariance of the distinct vectors, and projection on its eigenvectors.

Distinct integer vectors are packed into as few bytes as they need and written once. Their
sums are exact. Each task adds centred outer products in pairs of doubles (llm/doubles.py);
the pairs of all tasks are merged row by row of the matrix, in two levels, streaming. Only
that matrix, whose size is the dimension squared, reaches the driver, which solves it
(llm/eigen.py). Two narrow passes follow: one over the distinct vectors measures the
whitened covariance, one over all rows projects them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from weft.llm import doubles
from weft.llm.common import cut, in_arrow, named, partitions, table
from weft.llm.eigen import EPS, eigen

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries below this, in multiples of 1 / SCALE, have an x that is a long.
MOST = 2.0**63 - 2.0**21
#: Lists of one matrix row that a merge of the first level takes.
FAN_IN = 64
_SUMS = "dim int, pos int, n bigint, high bigint, low bigint"
_ROWS = "dim int, i int, part bigint, high array<double>, low array<double>"


# ---- vectors as bytes


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of each dimension in a list<double> column without nulls: x = floor(SCALE * c) + OFFSET."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    flat, starts = np.asarray(column.flatten(), dtype=np.float64), np.concatenate(([0], np.cumsum(lengths)))
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        c = flat[starts[rows][:, None] + np.arange(d)]
        yield rows, np.floor(SCALE * c).astype(np.int64) + OFFSET


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as one blob: bytes of an entry, then the entries less OFFSET, little-endian. Equal vectors have equal blobs."""
    for batch in batches:
        out = []
        for _, x in _matrices(batch.column(0)):
            own = x - OFFSET
            need = np.select([np.abs(own + (own < 0)).max(1) < 2**k for k in (7, 15, 31)], [1, 2, 4], 8)
            for size in np.unique(need):
                part = own[need == size].astype(f"<i{size}")
                head = np.full((len(part), 1), size, np.uint8)
                blob = np.hstack((head, part.view(np.uint8).reshape(len(part), -1)))
                out += [r.tobytes() for r in blob]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch of blobs as matrices, at most doubles.TERMS rows each, one dimension and entry size each."""
    by: dict[tuple[int, int], list[bytes]] = {}
    for blob in column.to_pylist():
        by.setdefault((blob[0], len(blob)), []).append(blob)
    for (size, _), own in by.items():
        for at in range(0, len(own), doubles.TERMS):
            part = own[at : at + doubles.TERMS]
            raw = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1)[:, 1:]
            yield np.ascontiguousarray(raw).view(f"<i{size}").astype(np.int64) + OFFSET


# ---- the fit


@dataclass
class Model:
    """Of one dimension: n distinct vectors, their exact sums, the mean as a pair, the components (columns) and their eigenvalues."""

    n: int
    sums: list[int]
    mean: doubles.Pair
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> doubles.Pair:
        """x minus the mean."""
        high = x.astype(np.float64)
        low = (x - high.astype(np.int64)).astype(np.float64)
        s, e = doubles.two_sum(high, -self.mean[0])
        e = e + (low - self.mean[1])
        out = s + e
        return out, e - (out - s)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum)^2, exact; None beyond a long."""
        most = float(np.abs(x.astype(np.float64)).max()) * self.n + max(map(abs, self.sums))
        if most < 2.0**62:
            t = self.n * x - np.array(self.sums, np.int64)
            if x.shape[1] * float(np.abs(t).max()) ** 2 < 2.0**62:
                return (t * t).sum(1).tolist()
        t = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (t * t).sum(1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the components over the root of their eigenvalues; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(x)[0] @ self.vectors) / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for x in _unpacked(batch.column(0)):
            own = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
            own[0] += len(x)
            own[1] += (x >> 32).sum(0)
            own[2] += (x & 0xFFFFFFFF).sum(0)
    for d, (n, high, low) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)], names=["dim", "pos", "n", "high", "low"])


def _outer(models: dict[int, Model], of: Callable[[Model, np.ndarray], doubles.Pair]):
    """Upper rows of the summed outer products of of(model, x), one list of rows a task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, doubles.Pair] = {}
        for batch in batches:
            for x in _unpacked(batch.column(0)):
                y = of(models[x.shape[1]], x)
                own = doubles.product((np.ascontiguousarray(y[0].T), np.ascontiguousarray(y[1].T)), y)
                held[x.shape[1]] = doubles.add(held[x.shape[1]], own) if x.shape[1] in held else own
        for d, pair in held.items():
            for i in range(len(pair[0])):
                yield _row(d, i, TaskContext.get().partitionId(), pair[0][i, i:], pair[1][i, i:])

    return run


def _row(dim: int, i: int, part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (high, low)]
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([part], pa.int64()), *lists], names=["dim", "i", "part", "high", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each run of equal (dim, i, part): the pairs are added, one held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k, dim in enumerate(batch.column(0).to_pylist()):
                yield (dim, batch.column(1)[k].as_py(), batch.column(2)[k].as_py()), np.asarray(batch.column(3)[k].values), np.asarray(batch.column(4)[k].values)

    for key, own in groupby(rows(), lambda r: r[0]):
        total = None
        for _, high, low in own:
            total = (high, low) if total is None else doubles.add(total, (high, low))
        yield _row(*key, *total)


def _gathered(found: DataFrame, width: Callable[[int], int]) -> dict[int, doubles.Pair]:
    """The symmetric matrix of each dimension; lists of up to FAN_IN tasks are merged first, then these. Its size is width(dimension) squared, whatever the rows."""
    n = partitions(found.sparkSession)
    for group in (F.floor(F.col("part") / FAN_IN), F.lit(0).cast("bigint")):
        order = ["dim", "i", "group", "part"]
        met = found.withColumn("group", group).repartition(n, "dim", "i", "group").sortWithinPartitions(*order)
        found = in_arrow(met.select("dim", "i", F.col("group").alias("part"), "high", "low"), _merge, _ROWS)
    out: dict[int, doubles.Pair] = {}
    for r in found.collect():
        high, low = out.setdefault(r.dim, (np.zeros((width(r.dim),) * 2), np.zeros((width(r.dim),) * 2)))
        high[r.i, r.i :] = high[r.i :, r.i] = r.high
        low[r.i, r.i :] = low[r.i :, r.i] = r.low
    return out


def _white(model: Model, x: np.ndarray) -> doubles.Pair:
    return doubles.exact(np.nan_to_num(model.whitened(x)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each dimension of `vectors`, one column of arrays of doubles without nulls or non-finite entries."""
    packed = cut(in_arrow(vectors, _pack, "x binary").distinct())
    sums = in_arrow(packed, _sums, _SUMS).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    models: dict[int, Model] = {}
    for dim, own in groupby(sorted(sums.collect(), key=lambda r: (r.dim, r.pos)), lambda r: r.dim):
        own = list(own)
        total = [(int(r.high) << 32) + int(r.low) for r in own]
        mean = [Fraction(s, own[0].n) for s in total]
        high = [float(m) for m in mean]
        models[dim] = Model(own[0].n, total, (np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(mean, high, strict=True)])))
    if not models:
        return models
    for dim, pair in _gathered(in_arrow(packed, _outer(models, Model.centred), _ROWS), lambda d: d).items():
        m = models[dim]
        v = doubles.scaled(pair, float(m.n))
        values, vectors_ = eigen(v)
        trace = float(v[0].trace() + v[1].trace())
        values = np.where(values > dim * EPS * values[0], values, 0.0)[:components]
        m.values, m.vectors = values, np.ascontiguousarray(vectors_[:, :components])
        m.explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    for dim, pair in _gathered(in_arrow(packed, _outer(models, _white), _ROWS), lambda d: min(d, components)).items():
        m = models[dim]
        some = m.values > 0
        off = (pair[0] / m.n - np.eye(len(m.values)))[np.ix_(some, some)]
        m.identity_error = float(np.abs(off).max(initial=0.0))
    return models


# ---- all rows


def _project(models: dict[int, Model], names: list[str]):
    lists = lambda a: pa.array([[None if v != v else v for v in r] for r in a.tolist()] if np.isnan(a).any() else a.tolist(), pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                for at in range(0, len(rows), doubles.TERMS):
                    m, own = models[x.shape[1]], x[at : at + doubles.TERMS]
                    ids = batch.column(0).take(pa.array(rows[at : at + doubles.TERMS]))
                    k = len(own)
                    explained = np.tile(m.explained, (k, 1))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([m.n] * k, pa.int64()), pa.array(m.deviations(own), pa.int64()), lists(m.whitened(own)), lists(explained), pa.array([m.identity_error] * k, pa.float64())], names=names
                    )

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_col, n, deviation, whitened (array), explained (array), identity_error; one row per row of df that takes part.

    Entries c become x = floor(64 * c) + 1000000. Rows whose vector is null, empty, or
    holds an entry that is null, non-finite or beyond 2**57 (whose x is no long) take no
    part. Each distinct x vector is fitted once, so copies weigh nothing. Vectors are
    whitened among those of their own dimension. whitened: the centred x on the first
    `components` unit eigenvectors of the covariance (divisor n), by falling eigenvalue,
    over the eigenvalue's root; a sign is arbitrary but the same for all rows, as is the
    order and turn of equal eigenvalues. A component without variance (all vectors of a
    dimension alike, or fewer than the dimension) has a null coordinate and explains 0;
    where no vector differs, explained is null. deviation is exact, null beyond a long.
    identity_error is measured over the fitted vectors and components with variance.
    Rows with a null id, repeated ids or repeated vectors are returned each; other
    columns, whatever their names, are ignored. An empty table gives no rows.
    """
    vec = named(vec_col)
    inside = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < MOST), F.lit(False)))
    rows = df.where(F.coalesce(inside, F.lit(False)) & (F.size(vec) > 0)).select(named(id_col).alias("id"), vec.cast("array<double>").alias("vec"))
    models = fit(rows.select("vec"), components)
    fields = [StructField("id", rows.schema["id"].dataType), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType())), StructField("explained", ArrayType(DoubleType())), StructField("identity_error", DoubleType())]
    found = in_arrow(rows, _project(models, [f.name for f in fields]), StructType(fields))
    return found.select(F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("pos")).alias("explained"), "identity_error")
