"""Class-based n-gram scoring: exchange clustering of words, class transitions, word emissions.

Texts are read once and kept as blocks of word numbers with each block's own dictionary,
so that what is shuffled afterwards are a block's distinct words, each once, never its tokens.

Clustering is in two steps. The frequent words - those with at least SHARE of the training
tokens, so no more than 1 / SHARE of them whatever the corpus - are moved between classes
in rounds: every word's counts of neighbours stand in one row, and each round broadcasts
only the classes and the matrix of class bigrams. A round that doesn't raise the
likelihood is undone. Every other word, however rare, then goes to the class that
its own neighbours in the whole training corpus favour.

P(word | class before) = (1 - e) * P(class | class before) * count(word) / count(class), and e
is the share of the class before for all words that are not known, learned from the words
that occur once. Over all words and the unknown one it sums to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from weft.llm.common import cut, in_arrow, named, partitions, table
from weft.llm.exchange import freeze, heads, thaw

CLASSES = 64
#: Words with this share of the training tokens are moved in rounds.
SHARE = 1e-5
ROUNDS = 9
#: Weight of the class frequencies in a transition.
MU = 8.0
#: Text bytes of a block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Word pairs that a task holds before it sends them on.
PAIRS = 1_000_000
#: Partitions of the frequent words' neighbours, a table of bounded size.
PARTS = 16
ONCE = 0x80
_CONTEXTS = "word string, block bigint, pos int, ctx binary"
_ANSWERS = "block bigint, pos int, cnt bigint, class int"
_WORDS = "word string, cnt bigint, class int"
_LISTS = "w int, side int, others array<int>, counts array<int>"
_PROFILE = "w int, right array<int>, right_n array<bigint>, left array<int>, left_n array<bigint>"


# ---- blocks of word numbers


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the words of all texts, tokens of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    return flat.filter(full).dictionary_encode(), np.bincount(np.asarray(parent.filter(full)), minlength=len(texts))


def _write_blocks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches([b for b, _, _ in held])
            words = pa.chunked_array([t for _, t, _ in held]).unify_dictionaries()
            codes, n = np.concatenate([np.asarray(c.indices, dtype=np.int32) for c in words.chunks]), np.concatenate([x for _, _, x in held])
            words, learns = words.chunk(0).dictionary, np.asarray(rows.column("learns"))
            blob = freeze(codes=codes, words=np.frombuffer("\n".join(words.to_pylist()).encode(), np.uint8))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            ids = rows.column("id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids), one(pa.array(n, pa.int64())), one(pa.array(learns)), pa.array([int(n[learns].sum())]), pa.array([int(learns.sum())]), pa.array([blob], pa.binary())], names=names)

        for batch in batches:
            far = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = 0
            while at < batch.num_rows:
                done = int(far[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(far, done + BLOCK - size, "right")))
                own = batch.slice(at, to - at)
                held.append((own.drop_columns(["text"]), *tokens(own.column("text"))))  # word numbers are made a batch at a time
                size += int(far[to - 1]) - done
                if size >= BLOCK or to < batch.num_rows:
                    yield flush()
                    held, size, number = [], 0, number + 1
                at = to
        if held:
            yield flush()

    return run


@dataclass
class Block:
    """The rows of a block: tokens of each text, whether it is learned from, word numbers, words."""

    n: np.ndarray
    learns: np.ndarray
    codes: np.ndarray
    words: list[str]

    @staticmethod
    def read(n: pa.Scalar, learns: pa.Scalar, blob: pa.Scalar) -> Block:
        got = thaw(blob.as_buffer())
        text = got["words"].tobytes().decode()
        return Block(np.asarray(n.values), learns.values.to_numpy(zero_copy_only=False), got["codes"], text.split("\n") if text else [])

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, tokens of each text) of the texts that are learned from."""
        return self.codes[np.repeat(self.learns, self.n)], self.n[self.learns]

    def numbers(self, known: dict[str, int], other: int) -> np.ndarray:
        """known[word] of each word."""
        return np.fromiter((known.get(w, other) for w in self.words), np.int32, len(self.words))


def _each(run):
    """run(Block) over rows (n, learns, blob), then run(None)."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(Block.read(*(batch.column(k)[i] for k in range(3))))
        yield from run(None)

    return call


def chained(ids: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """end, the tokens of the first text, end, those of the second, ..., end."""
    out = np.full(len(ids) + len(n) + 1, end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n) + 1] = ids
    return out


def _counts(block: Block | None) -> Iterator[pa.RecordBatch]:
    if block is not None and len(block.words):
        c = np.bincount(block.learned()[0], minlength=len(block.words))
        some = c > 0
        yield pa.RecordBatch.from_arrays([pa.array(block.words, pa.string()).filter(pa.array(some)), pa.array(c[some].astype(np.int64))], names=["word", "cnt"])


# ---- neighbours of frequent words


def _lists(w: np.ndarray, side: int, others: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (w, side, others, counts) of entries that are sorted by w."""
    if not len(w):
        return
    cuts = np.append(np.flatnonzero(heads(w)), len(w))
    for at in range(0, len(cuts) - 1, 512):
        own = cuts[at : at + 513]
        part, off = slice(own[0], own[-1]), pa.array((own - own[0]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(w[own[:-1]].astype(np.int32)), pa.array(np.full(len(own) - 1, side, np.int32)), pa.ListArray.from_arrays(off, pa.array(others[part].astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(counts[part].astype(np.int32)))], names=["w", "side", "others", "counts"]
        )


def _pairs(sent, m: int):
    """Neighbours of each frequent word (right of it: side 0, of the end mark and the other words too; left: side 1), summed in the task."""
    end, rest, width = m, m + 1, m + 2

    def run():
        known = {w: i for i, w in enumerate(sent.value)}
        keys, counts, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def fold():
            nonlocal keys, counts, more
            k, c = np.concatenate([keys, *(x[0] for x in more)]), np.concatenate([counts, *(x[1] for x in more)])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            at = np.flatnonzero(heads(k))
            keys, counts, more = k[at], np.add.reduceat(c, at) if len(at) else c, []

        def flush():
            nonlocal keys, counts
            fold()
            a, b = keys // width, keys % width
            yield from _lists(a, 0, b, counts)
            order = np.argsort(b, kind="stable")
            order = order[b[order] < m]
            yield from _lists(b[order], 1, a[order], counts[order])
            keys, counts = keys[:0], counts[:0]

        def one(block: Block | None) -> Iterator[pa.RecordBatch]:
            if block is None:
                yield from flush()
                return
            ids, n = block.learned()
            if not len(n):
                return
            seq = chained(block.numbers(known, rest)[ids], n, end)
            for at in range(0, len(seq) - 1, PAIRS // 4):
                own = seq[at : at + PAIRS // 4 + 1].astype(np.int64)
                more.append(np.unique(own[:-1] * width + own[1:], return_counts=True))
                if sum(len(x[0]) for x in more) > PAIRS // 2:
                    fold()
                    if len(keys) > PAIRS:
                        yield from flush()

        return one

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each(run())(batches)

    return call


def _profiles(m: int):
    """One row a word of its rows of lists, which come sorted by word; only one word's counts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, last = np.zeros((2, m + 2), np.int64), None

        def row() -> pa.RecordBatch:
            lists = []
            for s in (0, 1):
                at = np.flatnonzero(dense[s])
                lists += [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(v)) for v in (at.astype(np.int32), dense[s][at])]
            dense[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *lists], names=["w", "right", "right_n", "left", "left_n"])

        for batch in batches:
            w, side, off = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2).offsets)
            others, counts, far = np.asarray(batch.column(2).values), np.asarray(batch.column(3).values), np.asarray(batch.column(3).offsets)
            for i in range(len(w)):
                if last is not None and w[i] != last:
                    yield row()
                last = int(w[i])
                dense[side[i], others[off[i] : off[i + 1]]] += counts[far[i] : far[i + 1]]
        if last is not None:
            yield row()

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    cols = [(np.asarray(batch.column(k).offsets), np.asarray(batch.column(k).values)) for k in (1, 2, 3, 4)]
    for i, w in enumerate(batch.column(0).to_pylist()):
        yield w, *(v[o[i] : o[i + 1]] for o, v in cols)


# ---- exchange


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """Of the training tokens under class bigrams, up to a constant of the words alone."""
    return float(_f(matrix).sum() - _f(matrix.sum(0)).sum() - _f(matrix.sum(1)).sum())


def gains(matrix: np.ndarray, classes: int, now: int, right: np.ndarray, left: np.ndarray, own: int) -> np.ndarray:
    """likelihood() after the word went from class `now` to each class, less that without the word. right, left: its neighbours by class; own: how often it follows itself."""
    base = matrix.astype(np.float64)
    base[now] -= right
    base[:, now] -= left
    base[now, now] += own
    right, left = right.astype(np.float64), left.astype(np.float64)
    right[now] -= own
    left[now] -= own
    k, at = classes, np.arange(classes)
    fb = _f(base)
    rows = _f(base[:k] + right) - fb[:k]
    cols = (_f(base[:, :k] + left[:, None]) - fb[:, :k]).T
    rows[at, at] = 0
    cols[at, at] = 0
    both = _f(base[at, at] + right[:k] + left[:k] + own) - fb[at, at]
    r, c = base.sum(1)[:k] + left[:k], base.sum(0)[:k] + right[:k]  # tokens of each class, the word's own left out
    return rows.sum(1) + cols.sum(1) + both - (_f(r + right.sum() + own) - _f(r)) - (_f(c + left.sum() + own) - _f(c))


def _matrix(of: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            for w, right, n, _, _ in _rows(batch):
                total[of[w]] += np.bincount(of[right], n, width).astype(np.int64)
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(total[i]))], names=["i", "counts"])

    return run


def _moves(of: np.ndarray, matrix: np.ndarray, classes: int, moved):
    """(w, class) of the words that are better off elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for w, right, n, left, k in _rows(batch):
                if w < len(of) - 2 and moved(w):
                    own = int(n[right == w].sum())
                    gain = gains(matrix, classes, of[w], np.bincount(of[right], n, len(matrix)), np.bincount(of[left], k, len(matrix)), own)
                    best = int(np.argmax(gain))
                    if gain[best] > gain[of[w]] + 1e-9 * (1 + abs(gain[of[w]])):
                        out.append((w, best))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32())], names=["w", "class"])

    return run


def exchange(profiles: DataFrame, m: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each frequent word, of the end mark and of the other words; matrix of class bigrams).

    The words start dealt over the classes by rank. Words that move together could spoil
    each other's gains, so a round moves one of `parts` sets; where the likelihood falls
    nevertheless, the round is undone and the sets become smaller.
    """
    of = np.append(np.arange(m) % classes, [classes, classes + 1]).astype(np.int64)
    width = classes + 2

    def counted(of: np.ndarray) -> np.ndarray:
        out = np.zeros((width, width), np.int64)
        for r in in_arrow(profiles, _matrix(of, width), "i int, counts array<bigint>").collect():
            out[r.i] += np.array(r.counts, np.int64)
        return out

    matrix = counted(of)
    parts, still = 3, 0
    for r in range(rounds if m else 0):
        found = in_arrow(profiles, _moves(of, matrix, classes, lambda w, p=parts, r=r: w % p == r % p), "w int, class int").collect()
        still = 0 if found else still + 1
        if still == parts:
            break
        if not found:
            continue
        tried = of.copy()
        tried[[x[0] for x in found]] = [x[1] for x in found]
        new = counted(tried)
        if likelihood(new) > likelihood(matrix):
            of, matrix = tried, new
        else:
            parts, still = parts * 2, 0
    return of, matrix


# ---- the other words


def _blobs(entries: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A binary of `rows[i]` entries for each i."""
    off = np.concatenate(([0], np.cumsum(rows))) * entries.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])


def _contexts(sent, of: np.ndarray, m: int):
    """(word, block, pos, ctx) of each block's other words. ctx: for each class beside the word a byte, side * width + class (right is side 0), and a count of 16 bits."""
    end, rest, width = m, m + 1, int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(sent.value)}
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.read(*(batch.column(c)[k] for c in (1, 2, 3)))
                number = block.numbers(known, rest)
                ids, n = block.learned()
                seq, code = chained(number[ids], n, end), chained(ids, n, -1)[1:-1]
                here = np.flatnonzero(seq[1:-1] == rest)
                code, right, left = code[here].astype(np.int64), of[seq[here + 2]], of[seq[here]]
                key, cnt = np.unique(np.concatenate((code * 2 * width + right, code * 2 * width + width + left)), return_counts=True)
                times = -(-cnt // 0xFFFF)  # a higher count takes several entries
                if times.max(initial=1) > 1:
                    last = np.cumsum(times) - 1
                    key, more = np.repeat(key, times), np.full(int(times.sum()), 0xFFFF)
                    more[last] = cnt - (times - 1) * 0xFFFF
                    cnt = more
                entries = np.stack((key % (2 * width), cnt & 0xFF, cnt >> 8), 1).astype(np.uint8)
                per = np.bincount(key // (2 * width), minlength=len(number))
                asked = np.flatnonzero(number == rest)
                words, far = pa.array(block.words, pa.string()), np.concatenate(([0], np.cumsum(per)))
                for at in range(0, len(asked), 20_000):
                    own = asked[at : at + 20_000]  # words between them have no entries
                    yield pa.RecordBatch.from_arrays(
                        [words.take(pa.array(own)), pa.array([batch.column(0)[k].as_py()] * len(own), pa.int64()), pa.array(own.astype(np.int32)), _blobs(entries[far[own[0]] : far[own[-1] + 1]], per[own])], names=["word", "block", "pos", "ctx"]
                    )

    return run


def _placed(matrix: np.ndarray, classes: int, words: bool):
    """Rows of a word come together -> (block, pos, cnt, class) for each block that has it; with `words` (word, cnt, class) once.

    The class is the one that raises the likelihood most for each neighbour, as its first
    derivative says. A word that isn't learned from gives nothing. What is held of one
    word are 12 bytes a block.
    """
    width = classes + 2
    share = lambda c: np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * width))
    weight = np.concatenate((share(matrix[:classes].astype(float)).T, share(matrix.T[:classes].astype(float)).T))  # context by class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, dense, askers = None, np.zeros((1, 2 * width)), []  # of the last word so far

        def out(names: pa.Array, dense: np.ndarray, run_of: np.ndarray, block: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            cnt, best = dense[:, :width].sum(1).astype(np.int64), np.argmax(dense @ weight, 1).astype(np.int32)
            if words:
                yield pa.RecordBatch.from_arrays([names, pa.array(cnt), pa.array(best)], names=["word", "cnt", "class"]).filter(pa.array(cnt > 0))
                return
            some = np.flatnonzero(cnt[run_of] > 0)
            for at in range(0, len(some), 100_000):
                own = some[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(block[own]), pa.array(pos[own]), pa.array(cnt[run_of[own]]), pa.array(best[run_of[own]])], names=["block", "pos", "cnt", "class"])

        def last() -> Iterator[pa.RecordBatch]:
            block, pos = np.concatenate([a[0] for a in askers]), np.concatenate([a[1] for a in askers])
            yield from out(pa.array([word], pa.string()), dense, np.zeros(len(block), np.int64), block, pos)

        for batch in batches:
            names, block, pos = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            if not len(names):
                continue
            new = np.append(True, np.asarray(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False), bool))
            run_of = np.cumsum(new) - 1
            data, size = _sequences(batch, 3)
            entries = data.reshape(-1, 3).astype(np.int64)
            flat = np.repeat(run_of, size // 3) * (2 * width) + entries[:, 0]
            found = np.bincount(flat, entries[:, 1] + (entries[:, 2] << 8), (run_of[-1] + 1) * 2 * width).reshape(-1, 2 * width)
            firsts = names.filter(pa.array(new))
            first = int(np.searchsorted(run_of, 1))  # rows of the first run
            if word is not None and firsts[0].as_py() == word:
                dense += found[:1]
                askers.append((block[:first].copy(), pos[:first].copy()))
            else:
                if word is not None:
                    yield from last()
                word, dense, askers = firsts[0].as_py(), found[:1].copy(), [(block[:first].copy(), pos[:first].copy())]
            if len(firsts) == 1:
                continue
            yield from last()
            end = int(np.searchsorted(run_of, len(firsts) - 1))  # where the last run begins
            if end > first:
                yield from out(firsts.slice(1, len(firsts) - 2), found[1:-1], run_of[first:end] - 1, block[first:end], pos[first:end])
            word, dense, askers = firsts[-1].as_py(), found[-1:].copy(), [(block[end:].copy(), pos[end:].copy())]
        if word is not None:
            yield from last()

    return run


# ---- the model


@dataclass
class Model:
    """frequent: words by falling count, with counts and classes; matrix: class bigrams before the other words are placed; n, docs, distinct: training tokens, texts, words."""

    classes: int
    frequent: list[str]
    counts: np.ndarray
    of: np.ndarray
    matrix: np.ndarray
    n: int
    docs: int
    distinct: int


def _held(df: DataFrame, learns: Column, id_col: str, text_col: str) -> DataFrame:
    """The texts as blocks, written once."""
    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(kind)), StructField("n", ArrayType(LongType())), StructField("learns", ArrayType(BooleanType())), StructField("words", LongType()), StructField("docs", LongType()), StructField("blob", BinaryType())])
    return cut(in_arrow(rows, _write_blocks(schema.names), schema))


def fit(held: DataFrame, classes: int = CLASSES, share: float = SHARE, rounds: int = ROUNDS) -> Model:
    spark = held.sparkSession
    rows = held.select("n", "learns", "blob")
    total = held.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    n = int(total[0] + total[1])
    counted = in_arrow(rows, _each(_counts), "word string, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    often = counted.agg(F.count(F.lit(1)).alias("words"), F.collect_list(F.when(F.col("cnt") >= share * n, F.struct("word", "cnt"))).alias("often")).first()  # at most 1 / share words
    frequent = sorted(((r.word, r.cnt) for r in often.often), key=lambda r: (-r[1], r[0]))
    m = len(frequent)
    sent = spark.sparkContext.broadcast([w for w, _ in frequent])
    near = in_arrow(rows, _pairs(sent, m), _LISTS).repartition(partitions(spark), "w").sortWithinPartitions("w")
    profiles = cut(in_arrow(near, _profiles(m), _PROFILE)).coalesce(PARTS)
    of, matrix = exchange(profiles, m, classes, rounds)
    return Model(classes, sent.value, np.array([c for _, c in frequent], np.int64), of, matrix, n, int(total[1]), int(often.words + (total[1] > 0)))


def _place(held: DataFrame, model: Model, words: bool) -> DataFrame:
    spark, m = held.sparkSession, len(model.frequent)
    sent = spark.sparkContext.broadcast(model.frequent)
    asked = in_arrow(held.select("block", "n", "learns", "blob"), _contexts(sent, model.of, m), _CONTEXTS)
    met = asked.repartition(partitions(spark), "word").sortWithinPartitions("word")
    return in_arrow(met, _placed(model.matrix, model.classes, words), _WORDS if words else _ANSWERS)


def cluster_words(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(word, cnt, class) of every word that is learned from; the end mark is no word. See score_texts()."""
    held = _held(df, learns, id_col, text_col)
    model = fit(held, classes, share, rounds)
    frequent = df.sparkSession.createDataFrame([(w, int(c), int(k)) for w, c, k in zip(model.frequent, model.counts, model.of, strict=False)], _WORDS)
    return frequent.unionByName(_place(held, model, True))


# ---- scoring


def _classified(sent, model: Model, names: list[str]):
    """The texts of a block as classes, with the sums of log10 of counts + 1 and of counts over their words: (the block's row, its words that were found) -> its texts."""
    counts, of, unknown, held = model.counts, model.of[: len(model.counts)], model.classes + 1, []

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not held:
            held.append({w: i for i, w in enumerate(sent.value)})
        known, row = held[0], block.combine_chunks().to_batches()[0]
        own = Block.read(*(row.column(k)[0] for k in ("n", "learns", "blob")))
        number = own.numbers(known, len(known))
        c, cls = np.append(counts, 0)[number], np.append(of, unknown)[number]
        pos = found.column("pos").to_numpy()
        c[pos], cls[pos] = found.column("cnt").to_numpy(), found.column("class").to_numpy()
        doc = np.repeat(np.arange(len(own.n)), own.n)
        each = lambda v: np.bincount(doc, v[own.codes], len(own.n)) if len(own.codes) else np.zeros(len(own.n))
        byte = (cls | np.where(c == 1, ONCE, 0)).astype(np.uint8)
        seq = byte[own.codes] if len(own.codes) else np.zeros(0, np.uint8)
        return pa.Table.from_arrays(
            [row.column("ids")[0].values, pa.array(own.learns), pa.array(own.n + 1), pa.array(each((c > 0).astype(float)).astype(np.int64)), pa.array(each(np.log10(c + 1))), pa.array(each(np.log10(np.maximum(c, 1)))), _blobs(seq[:, None], own.n)], names=names
        )

    return run


def _sequences(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a binary column."""
    col = batch.column(at)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(off).astype(np.int64)


def _transitions(classes: int):
    """(a, b, cnt, once): class b after class a, and how often b's word is one that occurs once; such words also count as unknown ones before b."""
    width, unknown = classes + 2, classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnt, once = np.zeros(width * width, np.int64), np.zeros(width * width, np.int64)
        for batch in batches:
            seq = chained(*_sequences(batch, 0), classes)
            cls, single = (seq & (ONCE - 1)).astype(np.int64), seq >= ONCE
            for a, own in ((cls[:-1], slice(None)), (np.full(len(seq) - 1, unknown), single[:-1])):
                key = (a * width + cls[1:])[own]
                cnt += np.bincount(key, minlength=width * width)
                once += np.bincount(key[single[1:][own]], minlength=width * width)
        at = np.flatnonzero(cnt)
        yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width), pa.array(cnt[at]), pa.array(once[at])], names=["a", "b", "cnt", "once"])

    return run


def log_transitions(cnt: np.ndarray, once: np.ndarray, of_class: np.ndarray, mu: float = MU) -> np.ndarray:
    """log10 of (1 - e) * P(class | class before), and in the last column of e, the unknown word's share. of_class: training tokens of each class."""
    known = np.append(of_class, 0).astype(float)
    n, full = known.sum(), known > 0
    prior = np.where(full, (known + 1) / max(n + full.sum(), 1.0), 0.0)
    all_once = (once[:-1].sum() + 0.5) / (n + 1)
    total = cnt.sum(1)
    e = (once.sum(1) + all_once) / (total + 1)
    p = (cnt + mu * prior) / (total[:, None] + mu) * (1 - e[:, None])
    p[:, -1] = e
    with np.errstate(divide="ignore"):
        return np.log10(p)


def _scored(logs: np.ndarray, of_class: np.ndarray, model: Model, names: list[str]):
    classes, ends = model.classes, model.docs
    size = np.log10(np.maximum(np.append(of_class[:classes], [1, 1]), 1))  # the end mark and the unknown word are alone in their class
    smooth = np.log10(model.n + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, n = _sequences(batch, 6)
            seq = chained(data, n, classes if ends else classes + 1) & (ONCE - 1)
            doc = np.repeat(np.arange(len(n)), n + 1)
            base = np.asarray(batch.column(4)) + np.log10(ends + 1) - (n + 1) * smooth
            score = np.bincount(doc, logs[seq[:-1], seq[1:]] - size[seq[1:]], len(n)) + np.asarray(batch.column(5))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pc.add(batch.column(3), int(ends > 0)), pa.array(base), pa.array(score)], names=names)

    return run


def score_texts(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per row of df.

    The model is learned from all rows for which `learns` is true; the others, and those
    where it is null, are held out. Words are runs without ASCII white space, A-Z in lower
    case; each text ends in one end mark, which counts as a token and stands before the
    first word. base_score: log10 by single words, add-one smoothed; score: by the class
    model; perplexity: 10 ** (-score / n_tokens). A null text is an empty one, whose only token is the end mark. Very long texts are a
    block of their own. Rows with null or repeated ids are returned each, and repeated
    texts are learned from each time. Ties between classes go to the smaller one. With
    nothing to learn from, every token is unknown: base_score is 0 and an unknown token has
    probability 1/2. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    if not 1 <= classes <= 120:
        raise ValueError("classes must be 1 to 120")
    held = _held(df, learns, id_col, text_col)
    model = fit(held, classes, share, rounds)
    sent = df.sparkSession.sparkContext.broadcast(model.frequent)
    kind = held.schema["ids"].dataType.elementType
    fields = [StructField("id", kind), StructField("learns", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("more", DoubleType()), StructField("counts", DoubleType()), StructField("seq", BinaryType())]
    met = held.select("block", "ids", "n", "learns", "blob").groupBy("block").cogroup(_place(held, model, False).groupBy("block"))  # a group is one block
    texts = cut(met.applyInArrow(_classified(sent, model, [f.name for f in fields]), StructType(fields)))
    width = classes + 2
    cnt, once = np.zeros((width, width)), np.zeros((width, width))
    pairs = in_arrow(texts.where("learns").select("seq"), _transitions(classes), "a bigint, b bigint, cnt bigint, once bigint").groupBy("a", "b").agg(F.sum("cnt").alias("cnt"), F.sum("once").alias("once"))
    for r in pairs.collect():
        cnt[r.a, r.b], once[r.a, r.b] = r.cnt, r.once
    of_class = cnt[:-1].sum(0)[:-1]
    out = StructType([*fields[:4], StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    scored = in_arrow(texts, _scored(log_transitions(cnt, once, of_class), of_class, model, out.names), out)
    score = F.col("score")
    return scored.select(
        F.col("id").alias(id_col), (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", score, F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity")
    )


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder; such a text is learned from."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(remainder != 2, F.lit(True)))
