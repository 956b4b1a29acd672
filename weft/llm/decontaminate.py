"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. For each pattern length a shift table over
blocks of two words says how far a window end may move without missing an occurrence;
where the shift is zero, the patterns filed under that suffix block are compared word
by word and then byte by byte. Many lanes of the text advance in step, so the skipping
runs as array operations. A document never leaves its task: there is no shuffle.

A worker builds the tables of a block of the benchmark once and keeps them as arrays, about
ten bytes for each byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import extended, in_arrow, named, table
from weft.llm.exchange import spans_array
from weft.llm.hashing import WORD, U, mix, spread, words

WINDOW = 10
#: Benchmark text that is broadcast and searched at once; more is searched in further passes.
ITEMS_BLOCK = 8 << 20
#: Text bytes that are searched at once, and lanes.
BATCH, LANES = 1 << 20, 1024
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OUT = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"


def fold(text: bytes) -> bytes:
    """A-Z in lower case."""
    return text.translate(_FOLD)


def _block(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return (mix(a + b * U(0x9E3779B97F4A7C15)) & U(size - 1)).astype(np.int64)


class Text:
    """Words of texts: their hashes, of which text they are, and their bytes joined by single spaces."""

    def __init__(self, texts: list[bytes]):
        buf = b"\n".join(fold(t) for t in texts)
        self.hash, start, end = words(buf, WORD)
        far = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate(([0], np.searchsorted(start, far)))
        self.first, self.size = cuts[:-1], np.diff(cuts)
        arr = np.frombuffer(buf, np.uint8)
        keep = WORD[arr]
        joined = np.where(keep, arr, np.uint8(32))
        keep[end[end < len(arr)]] = True
        self.bytes = joined[keep]
        wide = end - start
        self.begin = np.cumsum(wide + 1) - (wide + 1)
        self.end = self.begin + wide


class Patterns:
    """Shift table and suffix buckets of the patterns of one length: runs of words of the items."""

    def __init__(self, items: Text, at: np.ndarray, item: np.ndarray, m: int):
        self.items, self.m, self.block = items, m, 2 if m > 1 else 1
        self.size = 1 << min(24, max(12, int(8 * len(at) * m).bit_length()))
        self.shift = np.full(self.size, m - self.block + 1, np.int16 if m < 1 << 15 else np.int32)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self.key(items.hash, at + end), self.shift.dtype.type(m - 1 - end))
        last = self.key(items.hash, at + m - 1).astype(np.int32)
        order = np.argsort(last, kind="stable")
        self.last, self.at, self.item = last[order], at[order], item[order]

    def key(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _block(hashes[end], hashes[end - 1] if self.block == 2 else np.zeros(len(end), np.uint64), self.size)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all places where the word hashes agree."""
        m, total = self.m, len(text)
        if total < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        width = max(64, -(-total // LANES))
        pos = np.arange(m - 1, total, width)
        stop = np.minimum(pos + width, total)
        ends = []
        while len(pos):
            move = self.shift[self.key(text, pos)]
            ends.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        ends = np.concatenate(ends)
        key = self.key(text, ends)
        lo, hi = np.searchsorted(self.last, key, "left"), np.searchsorted(self.last, key, "right")
        start, which = np.repeat(ends - m + 1, hi - lo), spread(lo, hi - lo)
        for j in range(m - 1, -1, -1):
            same = text[start + j] == self.items.hash[self.at[which] + j]
            start, which = start[same], which[same]
        return start, which

    def verified(self, docs: Text, word: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words from `word` on are the pattern's, byte by byte."""
        a, b = docs.begin[word], self.items.begin[self.at[which]]
        size = docs.end[word + self.m - 1] - a
        ok = size == self.items.end[self.at[which] + self.m - 1] - b
        for k in range(0, len(word), 1 << 14):
            own = np.flatnonzero(ok[k : k + (1 << 14)]) + k
            differ = docs.bytes[spread(a[own], size[own])] != self.items.bytes[spread(b[own], size[own])]
            ok[np.repeat(own, size[own])[differ]] = False
        return ok


def build(items: list[tuple[str | None, bytes]], window: int) -> list[Patterns]:
    text = Text([t for _, t in items])
    some = np.flatnonzero(text.size)
    m = np.minimum(text.size[some], window)
    out = []
    for length in np.unique(m).tolist():
        own = some[m == length]
        n = text.size[own] - length + 1
        out.append(Patterns(text, spread(text.first[own], n), np.repeat(own, n), length))
    return out


def search_texts(texts: list[bytes], patterns: list[Patterns], names: list[str | None]):
    """For each text: (number of words, hit spans as word ranges, item names)."""
    docs = Text(texts)
    doc_of = np.repeat(np.arange(len(texts)), docs.size)
    # a word that no pattern has stands after each text
    text = np.zeros(len(docs.hash) + len(texts), np.uint64)
    text[np.arange(len(docs.hash)) + doc_of] = docs.hash
    word_at = np.full(len(text), -1)
    word_at[np.arange(len(docs.hash)) + doc_of] = np.arange(len(docs.hash))
    spans: list[list] = [[] for _ in texts]
    found: list[set] = [set() for _ in texts]
    for p in patterns:
        at, which = p.search(text)
        word = word_at[at]
        ok = (word >= 0) & (word + p.m <= len(docs.hash))
        ok[ok] = doc_of[word[ok]] == doc_of[word[ok] + p.m - 1]
        word, which = word[ok], which[ok]
        ok = p.verified(docs, word, which)
        word, which = word[ok], which[ok]
        for d, w in np.unique(np.stack((doc_of[word], word), 1), axis=0).tolist():
            spans[d].append((w - int(docs.first[d]), w - int(docs.first[d]) + p.m))
        for d, i in np.unique(np.stack((doc_of[word], p.item[which]), 1), axis=0).tolist():
            found[d].add(names[i])
    return [(int(n), join_spans(x), sorted(y - {None})) for n, x, y in zip(docs.size, spans, found, strict=True)]


def join_spans(spans) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HELD: dict = {}


def _held(rows: list, window: int) -> list[Patterns]:
    """The tables of one block of items in a Python worker, whatever number of tasks it runs."""
    if _HELD.get("of") != (rows, window):
        _HELD.clear()
        _HELD.update(of=(rows, window), patterns=build(rows, window))
    return _HELD["patterns"]


def _search(sent, window: int, names: list[str], more: bool):
    """Texts are the second column; with `more`, the last two hold what earlier passes found."""

    def run(batches):
        patterns, own = _held(sent.value, window), [n for n, _ in sent.value]
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH):
                    size += len(texts[to])
                    to += 1
                found = search_texts(texts[at:to], patterns, own)
                part = batch.slice(at, to - at)
                if more:
                    before = zip(part.column(len(names) + 1).to_pylist(), part.column(len(names) + 2).to_pylist(), strict=True)
                    found = [(n, join_spans([*sp, *((x["start"], x["end"]) for x in s0)]), sorted({*it, *i0})) for (n, sp, it), (s0, i0) in zip(found, before, strict=True)]
                new = [pa.array([f[0] for f in found], pa.int64()), spans_array([f[1] for f in found]), pa.array([f[2] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *new], names=[*names, "n_words", "spans", "item_ids"])
                at = to

    return run


def _contamination(df: DataFrame, items: DataFrame, cols: list[str], item_id: str, item_text: str, window: int, nameless: bool) -> DataFrame:
    """c0, c1, ... (the columns `cols` of df, of which the second is the text), n_words, spans, item_ids."""
    spark = df.sparkSession
    some = F.lit(True) if nameless else named(item_id).isNotNull()
    used = items.where(some & named(item_text).isNotNull()).select(named(item_id).cast("string").alias("item"), named(item_text).alias("text"))
    size = used.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEMS_BLOCK))
    names = [f"c{i}" for i in range(len(cols))]
    out = df.select(*[named(c).alias(k) for c, k in zip(cols, names, strict=True)])
    schema = extended(out.schema.fields, _OUT)
    for k in range(n):
        own = used.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else used
        rows = [(r.item, r.text.encode("utf-8", "surrogatepass")) for r in own.collect()]
        out = in_arrow(out, _search(spark.sparkContext.broadcast(rows), window, names, k > 0), schema)
    return out


def find_contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, nameless: bool = True) -> DataFrame:
    """One row per row of df: id, n_words, spans (hit word ranges), item_ids (strings, sorted).

    Words are lower-cased (A-Z) runs of digits, letters and anything beyond ASCII. A
    pattern is `window` consecutive words of an item; a shorter item is one pattern as a
    whole. Null, empty and wordless texts have no words and are clean; null or wordless
    items match nothing. An item with a null id gives spans but no name; without `nameless`
    it takes no part. Repeated items and rows are harmless; texts are searched whole, however long. Other columns are
    ignored; an empty table gives no rows.

    The items are broadcast in blocks of ITEMS_BLOCK bytes, one narrow pass over the documents each.
    """
    found = _contamination(df, items, [id_col, text_col], item_id, item_text, window, nameless)
    return found.select(F.col("c0").alias(id_col), "n_words", "spans", "item_ids")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go, whether or not its item has an id.

    Null, empty and wordless texts stay; an empty table gives no rows; all columns,
    whatever their names, keep their values.
    """
    cols = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    found = _contamination(docs, table(spark, sf_dir, "benchmark"), cols, "item_id", "text", WINDOW, True).where(F.size("spans") == 0)
    return found.select(*[F.col(f"c{cols.index(c)}").alias(c) for c in docs.columns])


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LIST = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LIST} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LIST} AS w FROM benchmark),
p AS (SELECT item, least(len(w), {WINDOW}) AS m, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM i WHERE len(w) > 0),
pats AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS t FROM p),
dw AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM pats) WHERE len(w) >= m),
occ AS (SELECT r, s, pats.m, item FROM (SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS t FROM dw) x JOIN pats USING (m, t)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + m)) AS k FROM occ) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), ',') AS ids FROM occ GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
