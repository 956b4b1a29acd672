"""Substring dedup over words, by fixed-block anchors.

The corpus-wide index holds the non-overlapping 25-word reference blocks of every text
(those that begin at a multiple of 25). Every rolling 25-word window of every text is
probed against it. A 50-word window that also stands in another text holds a whole
reference block of that text, so only windows around a hit can be repeats: each hit is
extended to the 50-word windows that contain it, these are matched by 128-bit BLAKE2b
digests of their very words, and overlapping repeats merge into maximal ones.

Index and probes meet by ranges of a hash (weft.llm.exchange). Rolling hashes only choose
what is looked at; words that collide there cost a digest and decide nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import LONG_MIN, cut, in_arrow, partitions, table
from weft.llm.exchange import _ROWS, answers, ask, bits, blocks, each_block, freeze, from_bits, heads, joined_spans, note, spans_array, split_replies, thaw, with_answers
from weft.llm.hashing import NOT_SPACE, U, prefix, span, spread, words

LENGTH = 50
#: Probes of a bucket, about.
BUCKET = 1 << 20


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """Ids; a null one counts as the smallest."""
    return batch.column(1).fill_null(LONG_MIN).to_numpy(zero_copy_only=False)


class Words:
    """The words of a block's texts of at least `length` words."""

    def __init__(self, texts: list[bytes], length: int):
        self.buf, self.length, self.k = b"\n".join(texts), length, (length + 1) // 2
        self.hash, self.start, self.end = words(self.buf, NOT_SPACE)
        far = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate(([0], np.searchsorted(self.start, far)))
        self.doc = np.flatnonzero(np.diff(cuts) >= length)
        self.first, self.size = cuts[self.doc], np.diff(cuts)[self.doc]

    def rolling(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, key, document) of each rolling window of k words; the key is the first bits of a hash."""
        at, doc = spread(self.first, self.size - self.k + 1), np.repeat(np.arange(len(self.doc)), self.size - self.k + 1)
        return at, span(prefix(self.hash), at, at + self.k) >> U(64 - width) << U(64 - width), doc

    def normal(self) -> tuple[bytes, np.ndarray]:
        """(all words joined by a space, where each begins)."""
        arr = np.frombuffer(self.buf, np.uint8)
        keep = NOT_SPACE[arr]
        out = np.where(keep, arr, np.uint8(32))
        keep[self.end[self.end < len(arr)]] = True
        size = self.end - self.start + 1
        return out[keep].tobytes(), np.cumsum(size) - size


def extend(hits: np.ndarray, starts: np.ndarray, length: int, k: int, total: int) -> np.ndarray:
    """Of the windows of `length` words that begin at `starts` those that hold a hit of k words."""
    seen = np.zeros(total + 1, np.int64)
    seen[hits + 1] = 1
    seen = np.cumsum(seen)
    return starts[seen[starts + length - k + 1] > seen[starts]]


def _probes(length: int, width: int, buckets: int):
    """Every rolling window by key; it is said whether it begins as a reference block here, and whether two documents here have it."""

    def run(block, batch, _):
        w = Words(texts_of(batch), length)
        at, key, doc = w.rolling(width)
        if not len(at):
            return
        ref = (at - w.first[doc]) % w.k == 0
        of = np.unique(ids_of(batch), return_inverse=True)[1][w.doc][doc]
        order = np.argsort(key, kind="stable")
        key, own = key[order], np.flatnonzero(heads(key[order]))
        several = np.minimum.reduceat(of[order], own) != np.maximum.reduceat(of[order], own)
        flags = np.logical_or.reduceat(ref[order], own).astype(np.uint8) + 2 * several.astype(np.uint8)
        yield from ask(block, key[own], buckets, {"flags": flags})

    return each_block(run)


def _parted(flags: np.ndarray, held: list[dict]) -> list[bytes]:
    cuts = np.cumsum([len(h["key"]) for h in held])[:-1]
    return [bits(f) for f in np.split(flags, cuts)]


def _hit(held: list[dict]) -> list[bytes]:
    """A key is a hit if it is in the index and several documents have it."""
    _, at = np.unique(np.concatenate([h["key"] for h in held]), return_inverse=True)
    flags = np.concatenate([h["flags"] for h in held])
    several = (np.bincount(at) > 1) | (np.bincount(at, weights=flags >> 1) > 0)
    return _parted((several & (np.bincount(at, weights=flags & 1) > 0))[at], held)


def _windows(length: int, width: int, buckets: int, find: Callable):
    """The windows around hits by their digest, each distinct one once with its smallest id."""

    def run(block, batch, replies):
        w, ids = Words(texts_of(batch), length), ids_of(batch)
        at, key, doc = w.rolling(width)
        live = np.concatenate([from_bits(a) for a in split_replies(replies)[0]])
        hits = at[live[np.unique(key, return_inverse=True)[1]]]
        if not len(hits):
            return
        starts = find(hits, spread(w.first, w.size - length + 1), length, w.k, len(w.hash))
        if not len(starts):
            return
        text, begin = w.normal()
        stop = begin + (w.end - w.start)
        raw = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin[starts].tolist(), stop[starts + length - 1].tolist(), strict=True)])
        both = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
        own = np.searchsorted(w.first, starts, "right") - 1
        doc, lo = w.doc[own], starts - w.first[own]
        order = np.lexsort((ids[doc], both[:, 1], both[:, 0]))
        head = heads(both[order, 0], both[order, 1])
        entry = np.empty(len(order), np.int32)
        entry[order] = np.cumsum(head) - 1
        least = order[head]
        entry[ids[doc] > ids[doc[least]][entry]] = -1  # repeats already
        yield note(block, freeze(doc=doc.astype(np.uint32), lo=lo.astype(np.uint32), entry=entry))
        yield from ask(block, both[least, 0], buckets, {"low": both[least, 1], "id": ids[doc[least]]})

    return each_block(run)


def _earlier(held: list[dict]) -> list[bytes]:
    """Whether some other block has the window under a smaller id."""
    high, low, ids = (np.concatenate([h[c] for h in held]) for c in ("key", "low", "id"))
    order = np.lexsort((ids, low, high))
    head = heads(high[order], low[order])
    out = np.empty(len(order), bool)
    out[order] = ids[order] > ids[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    return _parted(out, held)


def _cut_out(length: int):
    def run(block, batch, replies):
        told, memo = split_replies(replies)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        if memo:
            got = thaw(memo)
            gone = got["entry"] < 0
            earlier = np.concatenate([np.zeros(0, bool), *map(from_bits, told)])
            gone[~gone] = earlier[got["entry"][~gone]]
            lo = got["lo"][gone].astype(np.int64)
            spans = joined_spans(got["doc"][gone].astype(np.int64), lo, lo + length, batch.num_rows)
        n, kept = [], []
        for text, gone in zip(texts_of(batch), spans, strict=True):
            own = text.split()
            n.append(len(own))
            for x, y in reversed(gone):
                del own[x:y]
            kept.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), spans_array(spans), pa.array(kept, pa.binary())], names=["id", "n_words", "spans", "kept"])

    return each_block(run)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, find: Callable = extend) -> DataFrame:
    """id, n_words, spans (removed word ranges), kept (binary, words joined by a space); one row per row of df.

    Words are runs of anything but ASCII white space. A word goes if a window of
    `length` words around it also starts in a document with a smaller id; windows are
    judged on the input. Null, empty and blank texts have no words. A null id counts as
    the least bigint and stays null; rows that share an id don't remove each other's words.
    Repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    find: which windows hold a hit, see extend().
    """
    held = blocks(df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("id")))
    size = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(4 * partitions(df.sparkSession), size // 5 // BUCKET)
    width = min(64, max(32, (size // 5).bit_length() + 8))
    hits = cut(answers(in_arrow(held, _probes(length, width, buckets), _ROWS), _hit))
    around = in_arrow(with_answers(held, hits), _windows(length, width, buckets, find), _ROWS)
    found = with_answers(held, answers(around, _earlier), "left")
    out = in_arrow(found, _cut_out(length), "id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string is compared in full; nothing is hashed before the digest of what is kept.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
hits AS (SELECT doc_id, i, 1 AS hit FROM windows JOIN firsts USING (k) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (
  SELECT doc_id, i, word, max(coalesce(hit, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM each LEFT JOIN hits USING (doc_id, i)),
sums AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)"""
