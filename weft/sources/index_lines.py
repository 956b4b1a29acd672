"""`term | url1 f1 url2 f2 ...` lines straight from documents, by arrays of word numbers.

Words of a slice of documents are numbered; a run of three, and the count of each word in
a document, move as numbers beside the words they stand for. Runs are dealt by their first two words,
single words by themselves, so a common word's n-grams spread over all tasks. Where they
arrive, runs are sorted, counted and joined to lines as arrays: no row is made for an n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import STOP_WORDS, terms

#: Text bytes of a task that makes lines, words that are numbered together, postings that are joined together.
TASK_BYTES, WORDS, POSTINGS = 10 << 20, 1 << 20, 1 << 18
SPACE, BAR = pa.scalar(" ", pa.large_string()), pa.scalar(" | ", pa.large_string())


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    """Strings one after the other in data; a length of -1 is a null."""
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0), dtype=np.int64)])
    whole = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
    null = lengths < 0
    return pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), whole) if null.any() else whole


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, bytes]:
    lengths = pc.fill_null(pc.binary_length(strings), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    whole = pc.fill_null(strings, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset)
    return lengths, whole.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if offsets[-1] > offsets[0] else b""


def _among(numbers: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ones of numbers below most, ascending, and the place among these, from 1, of each; zero for -1."""
    there = np.zeros(most + 1, bool)
    for x in numbers:
        there[x] = True
    there[-1] = False
    place = np.cumsum(there)
    place[-1] = 0
    return np.flatnonzero(there), [place[x] for x in numbers]


def _numbers(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each string among the distinct ones, -1 for null, and these."""
    coded = strings.dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _dealt(tasks: int):
    """(task, held): of each slice of (doc, words) what goes to each task."""

    def run(batches):
        for b in batches:
            words = b.column(1)
            ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                part = b.slice(at, upto - at)
                yield from _sent(part.column(0), part.column(1))
                at = upto

    def _sent(doc: pa.Array, words: pa.Array):
        n = np.diff(np.asarray(words.offsets))
        own, distinct = _numbers(words.flatten())
        if not len(own):
            return
        row, end = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n)
        place = np.arange(len(own))
        after = lambda k: np.where(place + k < end, own[np.minimum(place + k, len(own) - 1)], -1)
        head, two, three = own, after(1), after(2)
        has = two >= 0
        runs = np.stack([head[has], two[has], three[has]])
        of_run = row[has]
        key, count = np.unique(row * len(distinct) + own, return_counts=True)
        of_one, one = key // len(distinct), key % len(distinct)
        crc = np.array([zlib.crc32(w) for w in distinct.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        to_one = (crc[one] % np.uint64(tasks)).astype(np.int64)
        mixed = crc[runs[0]] * np.uint64(0x9E3779B97F4A7C15) + crc[runs[1]] * np.uint64(0xC2B2AE3D27D4EB4F)
        to_run = ((mixed >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)
        by_one, by_run = np.argsort(to_one, kind="stable"), np.argsort(to_run, kind="stable")
        cut_one = np.searchsorted(to_one[by_one], np.arange(tasks + 1))
        cut_run = np.searchsorted(to_run[by_run], np.arange(tasks + 1))
        out, size = [], 0
        for t in range(tasks):
            i, j = by_one[cut_one[t] : cut_one[t + 1]], by_run[cut_run[t] : cut_run[t + 1]]
            if len(i) or len(j):
                out.append((t, _held(doc, distinct, of_one[i], one[i], count[i], of_run[j], runs[:, j])))
                size += len(out[-1][1])
            if size > 4 << 20 or (t == tasks - 1 and out):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["task", "held"])
                out, size = [], 0

    return run


def _held(doc: pa.Array, distinct: pa.Array, of_one, one, count, of_run, runs) -> bytes:
    """Numbers of documents and words, and the strings they stand for, as bytes."""
    docs, (d1, d2) = _among([of_one, of_run], len(doc))
    words, w = _among([one, *runs], len(distinct))
    names, letters = _bytes_of(doc.take(pa.array(docs)))
    lengths, spelled = _bytes_of(distinct.take(pa.array(words)))
    kind = np.uint16 if max(len(docs), len(words)) + 1 < 1 << 16 else np.uint32
    head = np.array([np.dtype(kind).itemsize, len(docs), len(words), len(one), len(of_run), len(letters), len(spelled)], np.int64)
    # documents ascend, so steps between them take next to nothing once compressed
    steps = [np.diff(d, prepend=1).astype(kind).tobytes() for d in (d1, d2)]
    parts = [head.tobytes(), names.tobytes(), lengths.tobytes(), count.astype(np.int32).tobytes(), *steps, *(x.astype(kind).tobytes() for x in w), letters, spelled]
    held = b"".join(parts)
    return np.int64(len(held)).tobytes() + pa.compress(held, codec="zstd", asbytes=True)


def _lines(batches):
    """(term, line) of all that _dealt() sends to one task."""
    got = {k: [] for k in ("names", "letters", "lengths", "spelled", "count", "d1", "w1", "d2", "w2")}
    docs = words = 0
    for b in batches:
        for raw in b.column(1).to_pylist():
            raw = pa.decompress(raw[8:], int(np.frombuffer(raw, np.int64, 1)[0]), codec="zstd", asbytes=True)
            item, nd, nw, n1, n2, sd, sw = np.frombuffer(raw, np.int64, 7).tolist()
            kind, at = (np.uint16 if item == 2 else np.uint32), 56

            def take(what, n):
                nonlocal at
                own = np.frombuffer(raw, what, n, at)  # noqa: B023
                at += own.nbytes
                return own

            got["names"].append(take(np.int32, nd))
            got["lengths"].append(take(np.int32, nw))
            got["count"].append(take(np.int32, n1))
            got["d1"].append(np.cumsum(take(kind, n1), dtype=np.int32) + docs)
            got["d2"].append(np.cumsum(take(kind, n2), dtype=np.int32) + docs)
            w = take(kind, n1 + 3 * n2).astype(np.int32)
            w[w > 0] += words
            got["w1"].append(w[:n1])
            got["w2"].append(w[n1:].reshape(3, n2))
            got["letters"].append(raw[at : at + sd])
            got["spelled"].append(raw[at + sd : at + sd + sw])
            docs, words = docs + nd, words + nw
    if not docs:
        return
    doc, names = _numbers(_strings(np.concatenate(got.pop("names")), b"".join(got.pop("letters"))))
    word, spelled = _numbers(_strings(np.concatenate(got.pop("lengths")), b"".join(got.pop("spelled"))))
    # documents by their names, a null first
    rank = np.zeros(len(names) + 1, np.int64)
    by_name = pc.sort_indices(names).to_numpy()
    rank[by_name] = np.arange(1, len(names) + 1)
    doc = rank[doc]  # -1 is the last, zero
    names = pa.concat_arrays([pa.nulls(1, pa.large_string()), names.take(pa.array(by_name))])
    word = np.concatenate([[0], word + 1])
    one, two = word[np.concatenate(got.pop("w1"))], word[np.concatenate(got.pop("w2"), axis=1)]
    d1, d2, count = doc[np.concatenate(got.pop("d1"))], doc[np.concatenate(got.pop("d2"))], np.concatenate(got.pop("count")).astype(np.int64)
    third = two[2] > 0
    none = np.zeros
    for terms_, of, cnt in (
        ((one,), d1, count),
        ((two[0], two[1]), d2, none(0, np.int64)),
        ((two[0][third], two[1][third], two[2][third]), d2[third], none(0, np.int64)),
    ):
        if len(of):
            yield from _joined(terms_, of, cnt if len(cnt) else np.ones(len(of), np.int64), names, spelled)


def _joined(words: tuple[np.ndarray, ...], doc: np.ndarray, cnt: np.ndarray, names: pa.Array, spelled: pa.Array):
    """Lines of terms of one length: rows are a term's words (from 1), a document by its rank and a count."""
    key, wide = words[0], len(spelled) + 1
    for w in words[1:]:
        if int(key.max()) + 1 >= (1 << 62) // wide:  # numbers would not fit: those that occur are numbered anew
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + w
    order = np.lexsort((doc, key))
    key, doc, cnt = key[order], doc[order], cnt[order]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    cnt = np.add.reduceat(cnt, head)
    key, doc, order = key[head], doc[head], order[head]
    first = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(first) - 1
    many = np.flatnonzero((np.bincount(group) > 1)[group])
    again = many[np.lexsort((doc[many], -cnt[many], group[many]))]
    doc[many], cnt[many] = doc[again], cnt[again]
    begin = np.append(np.flatnonzero(first), len(key))
    at = 0
    while at < len(begin) - 1:
        upto = max(at + 1, int(np.searchsorted(begin, begin[at] + POSTINGS, "right")) - 1)
        lo, hi = begin[at], begin[upto]
        name, number = names.take(pa.array(doc[lo:hi])), pa.array(cnt[lo:hi]).cast(pa.large_string())
        pair = pc.coalesce(pc.binary_join_element_wise(name, number, SPACE), number)
        listed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begin[at : upto + 1] - lo), pair), SPACE)
        own = order[begin[at:upto]]
        term = pc.binary_join_element_wise(*[spelled.take(pa.array(w[own] - 1)) for w in words], SPACE)
        line = pc.binary_join_element_wise(term, listed, BAR)
        yield pa.RecordBatch.from_arrays([term.cast(pa.string()), line.cast(pa.string())], names=["term", "line"])
        at = upto


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term, line): index_text.global_lines() of the index of docs."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = docs.select(F.col(doc).cast("string").alias("doc"), terms(F.col(text), stop_words).alias("words"))
    return rows.mapInArrow(_dealt(tasks), "task int, held binary").repartitionById(tasks, F.col("task")).mapInArrow(_lines, "term string, line string")
