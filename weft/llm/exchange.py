"""Blocks of a corpus that put keyed questions to each other.

A corpus is dealt into blocks of about BLOCK text bytes, one row each, which are written
once. A block asks about sorted 64-bit keys, with columns beside them; the keys of all
blocks meet in buckets by ranges of the key, one bucket at a time; a bucket answers each
block in the order of its keys. Only keys, columns and answers move, compressed; texts
move once, when the blocks are dealt out. A key that a third of all rows share is asked
about once a block, so no bucket grows with it more than by that.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, in_arrow, partitions
from weft.llm.hashing import U, spread

#: Text bytes of a block; a longer text is a block of its own.
BLOCK = 4 << 20
_BLOCKS = "block bigint, bytes bigint, data binary"
_ADAPTIVE = "spark.sql.adaptive.enabled"
_ROWS = "bucket bigint, block bigint, blob binary"


def freeze(**cols: np.ndarray) -> bytes:
    """Arrays as one blob: bytes of like place stand together and compress."""
    planes = {}
    for name, v in cols.items():
        v = np.ascontiguousarray(v)
        planes[name] = (v.dtype.str, v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(planes, 5))


def thaw(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, planes) in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items():
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a group of sorted rows begins."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


# ---- blocks


def write_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_batch(data: bytes) -> pa.RecordBatch:
    got = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()
    return got[0]


def _deal(batches) -> Iterator[pa.RecordBatch]:
    """Rows (text first) in blocks."""
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0

    def flush():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([size], pa.int64()), pa.array([write_batch(whole)], pa.binary())], names=["block", "bytes", "data"])

    for b in batches:
        far = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            done = int(far[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(far, done + BLOCK - size, "right")))
            held.append(b.slice(at, to - at))
            size += int(far[to - 1]) - done
            if size >= BLOCK or to < b.num_rows:
                yield flush()
                held, size, k = [], 0, k + 1
            at = to
    if held:
        yield flush()


def blocks(rows: DataFrame) -> DataFrame:
    """block, bytes, data: the rows, whose first column is the text, written once.

    They are partitioned by block, and the plan knows it, so joins by block move no text.
    An adaptive plan would not say how its result is partitioned; this one needs no adaption.
    """
    spark = rows.sparkSession
    adaptive = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, "false")
    try:
        return cut(in_arrow(rows, _deal, _BLOCKS).repartition(partitions(spark), "block"))
    finally:
        spark.conf.set(_ADAPTIVE, adaptive)


# ---- questions and answers


def ask(block: int, key: np.ndarray, buckets: int, cols: dict[str, np.ndarray], flat: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Questions about ascending keys by bucket. flat: (bytes, length of each key's run of them)."""
    if not len(key):
        return
    bucket = bucket_of(key, buckets)
    cuts = np.append(np.flatnonzero(heads(bucket)), len(key))
    far = np.concatenate(([0], np.cumsum(flat[1]))) if flat else None
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = {n: c[a:b] for n, c in cols.items()}
        if flat:
            own["flat"] = flat[0][far[a] : far[b]]
        yield row(int(bucket[a]), block, freeze(key=deltas(key[a:b]), **own))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def row(bucket: int, block: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "block", "blob"])


def note(block: int, blob: bytes) -> pa.RecordBatch:
    """What a block tells itself: it comes back with the answers."""
    return row(-1 - block, block, blob)


def _settled(settle: Callable[[list[dict]], list[bytes]]):
    """Bucket by bucket, as the rows are sorted: settle(questions of each block) -> an answer for each."""

    def run(batches):
        last, of, held = None, [], []
        for batch in batches:
            for bucket, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket < 0:
                    yield row(bucket, block, blob)
                    continue
                if bucket != last and held:
                    for b, answer in zip(of, settle(held), strict=True):
                        yield row(last, b, answer)
                    of, held = [], []
                last = bucket
                of.append(block)
                held.append(_with_keys(thaw(blob)))
        if held:
            for b, answer in zip(of, settle(held), strict=True):
                yield row(last, b, answer)

    return run


def _with_keys(cols: dict) -> dict:
    cols["key"] = np.cumsum(cols["key"], dtype=np.uint64)
    return cols


def answers(asked: DataFrame, settle: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """block, replies: all answers to a block, and its notes."""
    n = partitions(asked.sparkSession)
    met = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    told = in_arrow(met, _settled(settle), _ROWS)
    return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("replies"))


def with_answers(held: DataFrame, told: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with their replies. Only replies are shuffled; they grow with the corpus, so they are never broadcast."""
    return held.join(told.hint("merge"), "block", how)


def split_replies(replies: list[dict] | None) -> tuple[list[bytes], bytes | None]:
    """(answers in the order of their keys, the note)."""
    got = sorted(replies or [], key=lambda r: r["bucket"])
    told = [r["blob"] for r in got if r["bucket"] < 0]
    return [r["blob"] for r in got if r["bucket"] >= 0], told[0] if told else None


def each_block(run: Callable[[int, pa.RecordBatch, list], Iterator[pa.RecordBatch]]):
    """run(block, rows, replies) over the rows (block, bytes, data[, replies]), one block at a time."""

    def call(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                replies = batch.column(3)[i].as_py() if batch.num_columns > 3 else None
                yield from run(batch.column(0)[i].as_py(), read_batch(batch.column(2)[i].as_buffer()), replies)

    return call


def bits(flags: np.ndarray) -> bytes:
    return freeze(bits=np.packbits(flags), n=np.array([len(flags)], np.int64))


def from_bits(blob: bytes) -> np.ndarray:
    got = thaw(blob)
    return np.unpackbits(got["bits"], count=int(got["n"][0])).astype(bool)


# ---- runs of bytes and covered ranges


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """Whether text[a:a + size] equals text[b:b + size], byte by byte, for each row."""
    out = np.ones(len(a), bool)
    far = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(far, (far[at - 1] if at else 0) + piece, "right")))
        own = size[at:to]
        differ = text[spread(a[at:to], own)] != text[spread(b[at:to], own)]
        out[at:to][np.repeat(np.arange(to - at), own)[differ]] = False
        at = to
    return out


def joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, docs: int) -> list[list[tuple[int, int]]]:
    """For each document the maximal ranges that its ranges cover."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    if not len(doc):
        return out
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max()) + 1
    far = np.maximum.accumulate(end + doc * wide) - doc * wide  # of the document so far
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    at = np.flatnonzero(head)
    for d, a, b in zip(doc[at].tolist(), start[at].tolist(), far[np.append(at[1:], len(doc)) - 1].tolist(), strict=True):
        out[d].append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)
