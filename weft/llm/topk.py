"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge.

A bounded block of queries goes to every task; each task multiplies tiles of it with tiles
of its own vectors, keeps k candidates a query and tile by partial selection, and
merges them into one list a query. The lists of all tasks are merged in two levels, so
no task sees more than a fixed share of them. More queries than a block are searched
block after block.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, in_arrow, table

#: Bytes of one block of queries, which is broadcast.
QUERY_BLOCK = 32 << 20
#: Vectors and queries in a tile.
TILE, QUERY_TILE = 4096, 1024
#: Task lists that one merge of the first level takes, at most k rows each.
FAN_IN = 64
_NONE, _LAST = np.int64(-(2**63)), np.int64(2**63 - 1)
_OUT = "query_id bigint, vec_id bigint, score bigint, task int"


def _matrices(ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
    """(dimension, ids, vectors) for each dimension."""
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), ids[rows], flat[starts[rows][:, None] + np.arange(d)].astype(np.float64)


def _integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python integers, also where the product is beyond doubles."""
    return np.array([[math.floor(Fraction(v) * Fraction(scale)) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def _products(q: np.ndarray, c: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Exact inner products of floor(scale * x); beyond 64 bits they are clamped.

    Doubles are exact below 2**53; the few queries or vectors beyond are multiplied as longs or Python integers.
    """
    d = q.shape[1]
    if not d or not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    with np.errstate(over="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * c)
    top_a, top_b = np.abs(a).max(1), np.abs(b).max(1)
    plain_a = top_a <= 2.0**26
    plain_b = d * max(1.0, float(top_a[plain_a].max(initial=0.0))) * top_b < 2.0**53
    out = np.empty((len(q), len(c)), np.int64)
    out[np.ix_(plain_a, plain_b)] = (a[plain_a] @ b[plain_b].T).astype(np.int64)
    for rows, cols in ((~plain_a, np.ones(len(c), bool)), (plain_a, ~plain_b)):
        if rows.any() and cols.any():
            if d * float(top_a[rows].max()) * float(top_b[cols].max()) < 2.0**62:
                out[np.ix_(rows, cols)] = a[rows].astype(np.int64) @ b[cols].astype(np.int64).T
            else:
                exact = _integers(q[rows], scale) @ _integers(c[cols], scale).T
                out[np.ix_(rows, cols)] = np.clip(exact, int(_NONE) + 1, int(_LAST)).astype(np.int64)
    return out


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id; ids ascend. Scores and places are one integer, so partial selection has no ties."""
    b = len(ids)
    if b > k:
        real = scores[scores != _NONE]
        top = int(np.abs(real).max()) if real.size else 0
        if top < 2**62 // (b + 1):
            key = np.where(scores == _NONE, np.int64(-(2**62)), scores * b + (b - 1 - np.arange(b)))
            at = np.argpartition(key, b - k, axis=1)[:, b - k :]
        else:
            at = np.argsort(scores.astype(object) * -1, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(scores, at, 1), ids[at]
    return scores, np.broadcast_to(ids, scores.shape)


def _merge(a, b, k: int):
    s, i = np.concatenate((a[0], b[0]), 1), np.concatenate((a[1], b[1]), 1)
    i = np.where(s == _NONE, _LAST, i)
    at = np.lexsort((i, -(s + 1)), axis=1)[:, :k]  # + 1: the least long has no negative
    return np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def _search(blocks, k: int, scale: float):
    def run(batches):
        from pyspark import TaskContext

        held = {d: (ids, q) for d, ids, q in blocks.value}
        best = {d: (np.full((len(ids), k), _NONE), np.full((len(ids), k), _LAST)) for d, (ids, _) in held.items()}
        for batch in batches:
            col = batch.column(1)
            lengths = np.asarray(col.value_lengths())
            ids, flat = np.asarray(batch.column(0)), np.asarray(col.flatten(), dtype=np.float64)
            for d, own, c in _matrices(ids, flat, lengths):
                if d not in held:
                    continue
                qid, q = held[d]
                order = np.argsort(own, kind="stable")
                for at in range(0, len(order), TILE):
                    part = order[at : at + TILE]
                    for x in range(0, len(qid), QUERY_TILE):
                        rows = slice(x, x + QUERY_TILE)
                        scores = _products(q[rows], c[part], scale)
                        scores[qid[rows, None] == own[part][None, :]] = _NONE
                        best[d][0][rows], best[d][1][rows] = _merge((best[d][0][rows], best[d][1][rows]), _select(scores, own[part], k), k)
        task = TaskContext.get().partitionId()
        for d, (s, i) in best.items():
            r, c = np.nonzero(s != _NONE)
            for at in range(0, len(r), 50_000):
                rr, cc = r[at : at + 50_000], c[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(held[d][0][rr]), pa.array(i[rr, cc]), pa.array(s[rr, cc]), pa.array(np.full(len(rr), task, np.int32))], names=["query_id", "vec_id", "score", "task"])

    return run


def top_k(df: DataFrame, is_query: F.Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k best other rows.

    Components become floor(scale * x), exactly, however large; the score is the integer
    inner product, clamped to 64 bits. Ties go to the smaller id. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part. Only vectors of one dimension are compared.
    Rows that share the query's id count as its own; of several query rows with one id
    the smallest vector is the query. Repeated candidate rows are listed each. An empty
    table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    sound = F.forall(F.col(f"`{vec_col}`"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    vectors = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    asked = rows.where(is_query).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).groupBy("id").agg(F.min("vec").alias("vec"))
    size = asked.agg(F.coalesce(F.sum(F.size("vec") + 1), F.lit(0))).first()[0] * 8
    n = max(1, -(-size // QUERY_BLOCK))
    parts = []
    for block in range(n):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block).toArrow() if n > 1 else asked.toArrow()
        col = own.column("vec").combine_chunks()
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        held = list(_matrices(np.asarray(own.column("id")), np.asarray(col.flatten(), dtype=np.float64), np.asarray(col.value_lengths(), dtype=np.int64))) if own.num_rows else []
        sent = spark.sparkContext.broadcast(held)
        found = in_arrow(vectors, _search(sent, k, scale), _OUT)
        parts.append(cut(found) if n > 1 else found)
        if n > 1:
            sent.destroy()
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)
    best = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_id", "group").orderBy(*best)
    lists = lists.withColumn("group", F.floor(F.col("task") / FAN_IN)).withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    every = Window.partitionBy("query_id").orderBy(*best)
    return lists.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
