"""Suffix-array dedup of byte strings.

Equal 100-byte strings have equal anchors at equal places: the least-hashed run of 48
bytes of each. Consecutive strings with one anchor are a stretch. Anchors that occur only
once need no further look; the other stretches, their bytes with them, meet in buckets by
anchor, so that equal strings always meet. There the suffixes are sorted: the kernel takes
one range of leading bytes at a time, sorts by 16 bytes and resolves longer ties by ranks
of a difference-cover sample computed beforehand: for any two places some shift below the
period lands both on the sample, so one comparison of ranks decides. Memory is bounded by
the sample and one range. (Burkhardt and Kärkkäinen, "Fast Lightweight Suffix Array
Construction and Checking".) Neighbours in suffix order that agree in `length` bytes are
one string, and all but its earliest occurrence go.

Stretches whose bytes are equal throughout are one stretch with its earliest place, before
they are sent and again before they are sorted. Hashes route; bytes decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from weft.llm.common import cut, extended, in_arrow, named, partitions, table
from weft.llm.exchange import _ROWS, answers, ask, bits, blocks, each_block, freeze, from_bits, heads, joined_spans, note, same_bytes, spans_array, split_replies, thaw, with_answers
from weft.llm.hashing import POWERS, U, byte_values, hash_runs, mix, prefix, span, spread
from weft.llm.substring_dedup import ids_of, texts_of

LENGTH, GRAM = 100, 48
#: Period and difference cover: every difference modulo 13 is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Suffixes in a range of leading bytes, about; bytes that are sorted together; bytes of a bucket, about.
RANGE, SORTED, BUCKET = 1 << 17, 1 << 20, 2 << 20
#: An anchor with more distinct stretches is hot: its strings are dealt out one by one, by a hash of their own.
HOT = 4096
#: Bytes hashed at once.
PIECE = 1 << 18
_INDEX = U((1 << 20) - 1)


# ---- the kernel


def _shifts() -> np.ndarray:
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


SHIFT = _shifts()


def eights(text: np.ndarray, pad: int) -> np.ndarray:
    """At each place the next eight bytes as a number, zeros beyond the end."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(pad + 8, np.uint8)))
    out = np.zeros(n + pad, np.uint64)
    for j in range(8):
        out = (out << U(8)) | wide[j : j + n + pad]
    return out


def cover_ranks(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at the sampled places, by prefix doubling; other places hold nothing of use."""
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    order = at[np.lexsort((keys[at + 8], keys[at]))]
    rank = np.full(2 * n + 64, -1, np.int64)
    head = heads(keys[order], keys[order + 8])
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = PERIOD
    while step < n + PERIOD:
        single = head & np.append(head[1:], True)
        loose = np.flatnonzero(~single)
        if not len(loose):
            break
        own = order[loose]
        nxt = rank[np.minimum(own + step, 2 * n + 63)]
        base = rank[own]
        o = np.lexsort((nxt, base))
        own, nxt, base = own[o], nxt[o], base[o]
        fresh = heads(base, nxt)
        order[loose] = own
        head[loose] = fresh
        rank[own] = loose[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        step *= 2
    return rank


def resolve(own: np.ndarray, tie: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes `own`, ascending by the number of their tie, in suffix order within ties.

    The members of a tie are sorted within each residue class by the class's own shift; a
    member's place is the sum over all classes of the members before it, by the shift that
    the two classes share.
    """
    wide = np.int64(len(rank) + 1)
    res, classes = own % PERIOD, []
    for r in range(PERIOD):
        at = np.flatnonzero(res == r)
        classes.append(at[np.argsort(tie[at] * wide + rank[own[at] + SHIFT[r, r]], kind="stable")])
    place = np.empty(len(own), np.int64)
    for r, mine in enumerate(classes):
        if not len(mine):
            continue
        before = np.arange(len(mine))
        for s, other in enumerate(classes):
            if s != r and len(other):
                d = SHIFT[r, s]
                before = before + np.searchsorted(tie[other] * wide + rank[own[other] + d], tie[mine] * wide + rank[own[mine] + d])
        place[mine] = before
    out = np.empty_like(own)
    out[place] = own
    return out


def sort_range(own: np.ndarray, keys: np.ndarray, ranks: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, heads of ties in the first 16 bytes). ranks(): the cover ranks, wanted only for ties of three and more."""
    own = own[np.lexsort((keys[own + 8], keys[own]))]
    head = heads(keys[own], keys[own + 8])
    tie = np.cumsum(head) - 1
    loose = np.flatnonzero(np.bincount(tie)[tie] > 2)
    if len(loose):
        own[loose] = resolve(own[loose], tie[loose], ranks())
    return own, head


def window_classes(text: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """A class number for each start; equal numbers mean equal text[start:start + length]. length >= 16."""
    keys = eights(text, length + 24)
    held: list = []

    def ranks() -> np.ndarray:
        if not held:
            held.append(cover_ranks(keys, len(text)))
        return held[0]

    lead = (keys[starts] >> U(48)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    far = np.cumsum(np.bincount(lead, minlength=1 << 16))
    out, done, cls = np.empty(len(starts), np.int64), 0, 0
    where = np.full(len(text) + 1, -1)
    where[starts] = np.arange(len(starts))
    while done < len(starts):
        to = int(far[np.searchsorted(far, min(done + RANGE, len(starts)), "left")])
        own, tied = sort_range(starts[by_lead[done:to]], keys, ranks)
        a, b = own[:-1], own[1:]
        same = np.flatnonzero(~tied[1:])
        for off in [*range(16, length - 8, 8), length - 8]:
            same = same[keys[a[same] + off] == keys[b[same] + off]]
        new = np.ones(len(own), np.int64)
        new[same + 1] = 0
        out[where[own]] = cls + np.cumsum(new)
        cls += int(new.sum())
        done = to
    return out


# ---- stretches


def anchored(text: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, gram: int):
    """Stretches of the segments text[first:first + size]: (anchor hash, span hash, first window, further windows)."""
    starts = spread(first, np.maximum(size - length + 1, 0))
    if not len(starts):
        return None
    sums = prefix(byte_values()[text])
    at = np.arange(len(text) - gram + 1)
    grams = span(sums, at, at + gram)
    least, width, want = (grams & ~_INDEX) | at.astype(np.uint64), 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    anchor = (least & _INDEX).astype(np.int64)[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(head)
    lo, p, more = starts[at], anchor[at], np.diff(np.append(at, len(starts))) - 1
    place = ((p - lo) << 32 | more).astype(np.uint64)
    return mix(grams[p]), mix(span(sums, lo, lo + more + length) + mix(place)), lo, more  # least hashes are small; mixed, they fill all buckets


class Stretches:
    """All stretches of a block's texts, in order; text: the texts one after the other."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        size = np.array([len(t) for t in texts], np.int64)
        self.base, self.text = np.cumsum(size) - size, np.frombuffer(b"".join(texts), np.uint8)
        # pieces of texts that overlap in all but one byte of a string, about PIECE bytes at a time
        n = np.maximum(-(-(size - length + 1) // PIECE), 0)
        begin = np.repeat(self.base, n) + PIECE * spread(np.zeros(len(n), np.int64), n)
        stop = np.minimum(begin + PIECE + length - 1, np.repeat(self.base + size, n))
        far, at, out = np.cumsum(stop - begin), 0, []
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(far, (far[at - 1] if at else 0) + PIECE + length, "right")))
            a, z = int(begin[at]), int(stop[to - 1])
            # pieces of one group follow each other, but for texts too short to count
            found = anchored(self.text[a:z], begin[at:to] - a, (stop - begin)[at:to], length, gram) if z - a < 1 << 20 else self._apart(begin[at:to], stop[at:to], length, gram)
            if found:
                h, c, lo, more = found
                out.append((h, c, lo + a if z - a < 1 << 20 else lo, more))
            at = to
        self.h, self.c, self.lo, self.more = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.doc = np.searchsorted(self.base, self.lo, "right") - 1

    def _apart(self, begin, stop, length, gram):
        out = []
        for a, z in zip(begin.tolist(), stop.tolist(), strict=True):
            h, c, lo, more = anchored(self.text[a:z], np.zeros(1, np.int64), np.array([z - a]), length, gram)
            out.append((h, c, lo + a, more))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(length: int, gram: int, buckets: int):
    """Every anchor of a block once, with the number of its stretches and of its distinct ones (255 stands for more)."""

    def run(block, batch, _):
        s = Stretches(texts_of(batch), length, gram)
        order = np.lexsort((s.c, s.h))
        h, c = s.h[order], s.c[order]
        own = np.flatnonzero(heads(h))
        if len(own):
            kinds, count = np.add.reduceat(heads(h, c).astype(np.int64), own), np.diff(np.append(own, len(h)))
            yield from ask(block, h[own], buckets, {"count": np.minimum(count, 255).astype(np.uint8), "kinds": np.minimum(kinds, 255).astype(np.uint8)})

    return each_block(run)


ONCE, SHARED, CROWDED = 0, 1, 2


def _status(hot: int):
    def settle(held: list[dict]) -> list[bytes]:
        _, at = np.unique(np.concatenate([h["key"] for h in held]), return_inverse=True)
        count, kinds = (np.bincount(at, weights=np.concatenate([h[c] for h in held])) for c in ("count", "kinds"))
        status = np.where(count < 2, ONCE, np.where(kinds > hot, CROWDED, SHARED)).astype(np.uint8)[at]
        return [freeze(status=x) for x in np.split(status, np.cumsum([len(h["key"]) for h in held])[:-1])]

    return settle


def _string_hashes(text: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    POWERS.need(length)
    out = np.empty(len(lo), np.uint64)
    for k in range(0, len(lo), 4096):
        own = byte_values()[text[lo[k : k + 4096, None] + np.arange(length)]]
        out[k : k + 4096] = mix((own * POWERS.up[:length]).sum(1, dtype=np.uint64))
    return out


def distinct(text: np.ndarray, lo: np.ndarray, size: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The representative of each row: the first of its group (rows `order`, groups begin at `head`) if the bytes are the same, else the row itself."""
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    other = np.flatnonzero(first != np.arange(len(first)))
    apart = other[~same_bytes(text, lo[other], lo[first[other]], size[other])]
    first[apart] = apart
    return first


def _ranks(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order of documents: by id, then hash of the text; repeated rows share a rank."""
    order = np.lexsort((hashes, ids))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(heads(ids[order], hashes[order]))
    return out


def _entries(length: int, gram: int, buckets: int):
    """The distinct stretches under anchors that are shared, with their bytes and earliest place."""

    def run(block, batch, replies):
        s = Stretches(texts_of(batch), length, gram)
        anchors, at = np.unique(s.h, return_inverse=True)
        status = np.concatenate([thaw(a)["status"] for a in split_replies(replies)[0]])[at]
        some, crowd = np.flatnonzero(status == SHARED), np.flatnonzero(status == CROWDED)
        lo = np.concatenate((s.lo[some], spread(s.lo[crowd], s.more[crowd] + 1)))
        more = np.concatenate((s.more[some], np.zeros(len(lo) - len(some), np.int64)))
        alone = _string_hashes(s.text, lo[len(some) :], length)
        key, c = np.concatenate((s.h[some], alone)), np.concatenate((s.c[some], alone))
        if not len(lo):
            return
        doc = np.searchsorted(s.base, lo, "right") - 1
        ids, ths = ids_of(batch), batch.column(2).to_numpy(zero_copy_only=False)
        rank, place = _ranks(ids, ths)[doc], lo - s.base[doc]
        order = np.lexsort((place, rank, more, c, key))
        first = distinct(s.text, lo, more + length, order, heads(key[order], c[order], more[order]))
        own = np.unique(first)
        own = own[np.argsort(key[own], kind="stable")]
        entry = np.empty(len(lo), np.int32)
        entry[own] = np.arange(len(own))
        entry = entry[first]
        earliest = (rank == rank[first]) & (place == place[first])
        yield note(block, freeze(doc=doc.astype(np.uint32), lo=place.astype(np.uint32), more=more.astype(np.uint8), entry=entry, first=earliest.astype(np.uint8)))
        size = more[own] + length
        cols = {"more": more[own].astype(np.uint8), "id": ids[doc[own]], "th": ths[doc[own]], "lo": place[own].astype(np.uint32)}
        yield from ask(block, key[own], buckets, cols, (s.text[spread(lo[own], size)], size))

    return each_block(run)


def _earlier(length: int, classes: Callable):
    """For each string of each stretch whether it also starts earlier."""

    def settle(held: list[dict]) -> list[bytes]:
        text = np.concatenate([h["flat"] for h in held])
        key, more, ids, ths, lo = (np.concatenate([h[c] for h in held]) for c in ("key", "more", "id", "th", "lo"))
        more, lo = more.astype(np.int64), lo.astype(np.int64)
        size = more + length
        begin = np.cumsum(size) - size
        c = hash_runs(text, begin, begin + size)
        order = np.lexsort((lo, ths, ids, more, c, key))
        first = distinct(text, begin, size, order, heads(key[order], c[order], more[order]))
        is_first = (ids == ids[first]) & (ths == ths[first]) & (lo == lo[first])
        string = np.cumsum(more + 1) - more - 1  # of each entry its first string
        out = np.repeat(~is_first, more + 1)
        # anchors with several stretches: their suffixes are sorted, some anchors at a time
        own = np.unique(first)
        own = own[np.argsort(key[own], kind="stable")]
        kind = np.cumsum(heads(key[own])) - 1
        own = own[np.bincount(kind)[kind] > 1]
        earlier = np.zeros(len(out), bool)
        cuts, far, at = np.append(np.flatnonzero(heads(key[own])), len(own)), np.concatenate(([0], np.cumsum(size[own]))), 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(far[cuts], far[cuts[at]] + SORTED, "right")) - 1)
            part = own[cuts[at] : cuts[to]]
            at = to
            n = more[part] + 1
            starts = spread(np.cumsum(size[part]) - size[part], n)
            of, off = np.repeat(part, n), spread(np.zeros(len(part), np.int64), n)
            cls = classes(text[spread(begin[part], size[part])], length, starts)
            order = np.lexsort((lo[of] + off, ths[of], ids[of], cls))
            head = heads(cls[order])
            least = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            a, b = of[order], of[least]
            later = (ids[a] != ids[b]) | (ths[a] != ths[b]) | (lo[a] + off[order] != lo[b] + off[least])
            earlier[(string[of] + off)[order]] = later
        same = np.flatnonzero(is_first)  # the earliest of equal stretches, and repeated rows of it
        out[spread(string[same], more[same] + 1)] = earlier[spread(string[first[same]], more[same] + 1)]
        cuts = np.cumsum([int((h["more"].astype(np.int64) + 1).sum()) for h in held])[:-1]
        return [bits(x) for x in np.split(out, cuts)]

    return settle


def _cut_out(length: int, keep: int, wanted: tuple[str, ...]):
    def run(block, batch, replies):
        told, memo = split_replies(replies)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        if memo:
            got = thaw(memo)
            doc, lo, more, entry, first = (got[c].astype(np.int64) for c in ("doc", "lo", "more", "entry", "first"))
            again = np.concatenate([np.zeros(0, bool), *map(from_bits, told)])
            size = np.zeros(int(entry.max()) + 1, np.int64)
            size[entry] = more + 1
            string = np.cumsum(size) - size
            some = np.flatnonzero(first)
            n = more[some] + 1
            off = spread(np.zeros(len(some), np.int64), n)
            gone = again[np.repeat(string[entry[some]], n) + off]
            d, a = np.repeat(doc[some], n)[gone], (np.repeat(lo[some], n) + off)[gone]
            rest = first == 0
            spans = joined_spans(np.concatenate((d, doc[rest])), np.concatenate((a, lo[rest])), np.concatenate((a + length, (lo + more)[rest] + length)), batch.num_rows)
        kept = []
        for text, gone in zip(texts_of(batch), spans, strict=True):
            at, parts = 0, []
            for x, y in gone:
                parts.append(text[at:x])
                at = y
            parts.append(text[at:])
            kept.append(b"".join(parts))
        size = [len(t) for t in texts_of(batch)]
        made = {"kept": lambda: pa.array(kept, pa.binary()), "kept_text": lambda: pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())}
        new = [pa.array(size, pa.int64()), pa.array([len(x) for x in kept], pa.int64()), spans_array(spans), *(made[w]() for w in wanted), batch.column(0).is_null()]
        yield pa.RecordBatch.from_arrays([batch.column(1), *(batch.column(3 + i) for i in range(keep)), *new], names=["id", *(f"k{i}" for i in range(keep)), "n_bytes", "n_kept", "spans", *wanted, "no_text"])

    return each_block(run)


def _found(df: DataFrame, id_col: str, text_col: str, length: int, keep: list[str], wanted: tuple[str, ...], classes: Callable = window_classes, hot: int = HOT) -> DataFrame:
    """id, k0, k1, ... (the columns `keep`), n_bytes, n_kept, spans, of kept and kept_text those `wanted`, no_text."""
    gram = min(GRAM, length)
    if length < 16:
        raise ValueError("length must be 16 or more")
    if length - gram > 254:
        raise ValueError("length must be 302 or less")
    n = partitions(df.sparkSession)
    rows = df.select(
        named(text_col).alias("text"), named(id_col).cast("bigint").alias("id"), F.xxhash64(named(text_col)).alias("th"), *[named(c).alias(f"k{i}") for i, c in enumerate(keep)]
    )
    held = blocks(rows)
    size = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(4 * n, size // BUCKET)
    status = cut(answers(in_arrow(held, _anchors(length, gram, buckets), _ROWS), _status(hot)))
    asked = in_arrow(with_answers(held, status), _entries(length, gram, buckets), _ROWS)
    found = with_answers(held, answers(asked, _earlier(length, classes)), "left")
    held_ = [StructField("id", LongType()), *(rows.schema[f"k{i}"] for i in range(len(keep)))]
    schema = extended(held_, ", ".join(["n_bytes bigint, n_kept bigint, spans array<struct<start:bigint,end:bigint>>", *({"kept": "kept binary", "kept_text": "kept_text string"}[w] for w in wanted), "no_text boolean"]))
    return in_arrow(found, _cut_out(length, len(keep), wanted), schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None, wanted: tuple[str, ...] = ("kept", "kept_text"), classes: Callable = window_classes, hot: int = HOT) -> DataFrame:
    """id, the columns `keep`, n_bytes, spans (removed byte ranges), kept (binary), kept_text (its whole characters), no_text; one row per row of df. wanted: which of the two texts.

    A byte goes if a string of `length` bytes around it also starts earlier: in a
    document with a smaller id, or earlier in its own. Strings are judged on the input.
    A null or empty text has no bytes (no_text tells them apart). A null id counts as the
    least bigint and stays null; rows that share an id rank by a hash of their text, and
    rows that share both are one document, returned each. An empty table gives no rows.
    classes: the kernel, see window_classes().
    """
    keep = keep or []
    found = _found(df, id_col, text_col, length, keep, wanted, classes, hot)
    return found.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", *wanted, "no_text")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), wanted=("kept",))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated strings go from the texts, and texts that were nothing else go altogether.

    A character that lost some of its bytes loses the others. n_chars, where there is one,
    is counted anew; all other columns, whatever their names, keep their values. Null and
    empty texts stay as they are; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = _found(docs, "doc_id", "text", LENGTH, others, ("kept_text",)).where("n_kept > 0 OR n_bytes = 0")
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    out = {"doc_id": F.col("id").cast(docs.schema["doc_id"].dataType), "text": text} | {c: F.col(f"k{i}") for i, c in enumerate(others)}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])


#: Every string is compared in full; nothing is hashed before the digest of what is kept.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, c, substr(h, 200 * c + 1, 400) AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 199) // 200)) AS c FROM d)),
each AS (
  SELECT doc_id, 100 * c + j AS i, substr(p, 2 * j + 1, 2) AS byte, substr(p, 2 * j + 1, 200) AS k
  FROM (SELECT *, unnest(range(0, least(length(p) // 2, 100))) AS j FROM parts)),
firsts AS (SELECT k, min({'doc': doc_id, 'at': i}) AS first FROM each WHERE length(k) = 200 GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, 1 AS hit FROM each JOIN firsts USING (k) WHERE first <> {'doc': doc_id, 'at': i}),
marked AS (
  SELECT doc_id, i, byte, max(coalesce(hit, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) AS gone FROM each LEFT JOIN hits USING (doc_id, i)),
runs AS (SELECT *, gone > lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM marked),
sums AS (SELECT doc_id, sum(gone) AS n, count(*) FILTER (opens) AS spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)"""
