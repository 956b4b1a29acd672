"""SentencePiece encoding and decoding.

The pieces of a vocabulary form an Aho-Corasick automaton over bytes. One pass over a
text advances the automaton and, at each position, follows the output links from the
longest piece that ends there to the shortest, relaxing the best score of a split that
ends with it (Viterbi). A piece has white space only in front, so no piece spans the
start of a run of spaces: a text falls into units there, each distinct unit is split
once, and many units advance in step as arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import extended, fresh, in_arrow, named, table
from weft.llm.exchange import same_bytes
from weft.llm.hashing import hash_runs, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes whose units are split together.
BATCH = 2 << 20
#: Longer units advance alone.
LONG = 512


class Vocabulary(NamedTuple):
    """pieces[i] holds the bytes of id i, the space mark as a space, or None if texts don't match it; raw[b] is the id of byte b."""

    pieces: tuple
    scores: tuple
    raw: tuple
    decoded: tuple


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file, read by the driver and sent to the tasks (about a megabyte)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, decoded, raw = [], [], [None] * 256
    for i in range(sp.get_piece_size()):
        own = sp.id_to_piece(i).replace("▁", " ").encode()
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            raw[b] = i
            pieces.append(None)
            decoded.append(bytes([b]))
        else:
            plain = not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))
            pieces.append(own if plain else None)
            decoded.append(own if plain else b"")
    if None in raw:
        raise ValueError("the vocabulary has no piece for some byte")
    return Vocabulary(tuple(pieces), tuple(sp.get_score(i) for i in range(len(pieces))), tuple(raw), tuple(decoded))


def distinct_runs(arr: np.ndarray, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one run of each kind, the kind of every run): runs of equal hash are compared byte by byte, and those that differ stand alone."""
    hashes = hash_runs(arr, starts, starts + size) if hashes is None else hashes
    _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
    other = np.flatnonzero(pick[which] != np.arange(len(which)))
    like = pick[which[other]]
    same = size[other] == size[like]
    same[same] = same_bytes(arr, starts[other[same]], starts[like[same]], size[other[same]])
    apart = other[~same]
    which[apart] = len(pick) + np.arange(len(apart))
    return np.append(pick, apart), which


class Automaton:
    """Complete transition table, the piece that ends in a state, and links to the next shorter piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        child: list[dict[int, int]] = [{}]
        levels: list[list] = []
        piece = [-1]
        for i, p in enumerate(vocabulary.pieces):
            state = 0
            for depth, b in enumerate(p or b""):
                nxt = child[state].get(b)
                if nxt is None:
                    nxt = len(child)
                    child[state][b] = nxt
                    child.append({})
                    piece.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((nxt, state, b))
                state = nxt
            if p and piece[state] < 0:
                piece[state] = i
        n = len(child)
        self.piece = np.array(piece, np.int32)
        self.step = np.zeros((n, 256), np.int32)
        fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        if levels:
            s, _, b = np.array(levels[0]).T
            self.step[0, b] = s
        for depth, level in enumerate(levels):
            s, parent, b = np.array(level).T
            fail[s] = self.step[fail[parent], b] if depth else 0
            link[s] = np.where(self.piece[fail[s]] >= 0, fail[s], link[fail[s]])
            self.step[s] = self.step[fail[s]]
            if depth + 1 < len(levels):
                nxt, own, byte = np.array(levels[depth + 1]).T
                self.step[own, byte] = nxt
        self.link, self.first = link, np.where(self.piece >= 0, np.arange(n, dtype=np.int32), link)
        self.score = np.array(vocabulary.scores, np.float64)
        self.length = np.array([len(p or b"") for p in vocabulary.pieces], np.int64)
        used = [s for p, s in zip(vocabulary.pieces, vocabulary.scores, strict=True) if p is not None]
        #: A character without a piece of its own costs this and becomes its bytes.
        self.unknown = min(used, default=0.0) - 10.0

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of one length as a byte matrix -> (flat ids, ids per unit)."""
        n, size = rows.shape
        best = np.full((size + 1, n), -np.inf)
        back = np.full((size + 1, n), -1, np.int32)
        best[0], state = 0.0, np.zeros(n, np.int32)
        char, all_rows = np.zeros(n, np.int64), np.arange(n)
        for t in range(size):
            begins = (rows[:, t] & 0xC0) != 0x80
            char[begins] = t
            state = self.step[state, rows[:, t]]
            single = np.zeros(n, bool)
            out = self.first[state]
            at = np.flatnonzero(out)
            out = out[at]
            while len(at):
                p = self.piece[out]
                start = t + 1 - self.length[p]
                score = best[start, at] + self.score[p]
                better = score > best[t + 1, at]
                best[t + 1, at[better]], back[t + 1, at[better]] = score[better], p[better]
                single[at] |= start == char[at]
                out = self.link[out]
                on = out > 0
                at, out = at[on], out[on]
            ends = ~single & ((rows[:, t + 1] & 0xC0) != 0x80 if t + 1 < size else True)
            at = all_rows[ends]
            if len(at):
                score = best[char[at], at] + self.unknown
                better = score > best[t + 1, at]
                best[t + 1, at[better]], back[t + 1, at[better]] = score[better], -2 - (t - char[at[better]])
        pos, where = np.full(n, size), all_rows
        owners, ids = [], []
        raw = np.array(self.vocabulary.raw)
        while len(where):
            p = back[pos, where]
            known = p >= 0
            last = np.where(known, p, raw[rows[where, pos - 1]])
            owners.append(where)
            ids.append(last)
            # bytes of an unknown character leave one by one
            wide = p < -2
            if wide.any():
                back[pos[wide] - 1, where[wide]] = p[wide] + 1
            pos = pos - np.where(known, self.length[np.maximum(p, 0)], 1)
            on = pos > 0
            pos, where = pos[on], where[on]
        owner, flat = np.concatenate(owners)[::-1], np.concatenate(ids)[::-1]
        return flat[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=n)

    def split_long(self, unit: bytes) -> list[int]:
        """One unit, byte by byte: the same relaxation."""
        v, size = self.vocabulary, len(unit)
        best, back = [float("-inf")] * (size + 1), [(-1, 0)] * (size + 1)
        best[0], state, char = 0.0, 0, 0
        step, first, link, piece = self.step, self.first, self.link, self.piece
        for t, b in enumerate(unit):
            if b & 0xC0 != 0x80:
                char = t
            state = step[state, b]
            out, single = first[state], False
            while out:
                p = int(piece[out])
                start = t + 1 - len(v.pieces[p])
                single |= start == char
                score = best[start] + v.scores[p]
                if score > best[t + 1]:
                    best[t + 1], back[t + 1] = score, (p, start)
                out = link[out]
            if not single and (t + 1 == size or unit[t + 1] & 0xC0 != 0x80) and best[char] + self.unknown > best[t + 1]:
                best[t + 1], back[t + 1] = best[char] + self.unknown, (-1, char)
        ids, pos = [], size
        while pos:
            p, start = back[pos]
            ids.extend([p] if p >= 0 else [v.raw[b] for b in reversed(unit[start:pos])])
            pos = start
        return ids[::-1]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text); an empty text has none, any other is split with a space put in front."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        buf = b"".join(b" " + t for t in texts if t)
        arr = np.frombuffer(buf, np.uint8)
        if not len(arr):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.cumsum(sizes) - sizes
        space = arr == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[first[sizes > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(arr))
        pick, which = distinct_runs(arr, starts, ends - starts)
        s, size = starts[pick], (ends - starts)[pick]
        flats, owners = [], []
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            if d > LONG:
                for u in own:
                    flat = np.array(self.split_long(buf[s[u] : s[u] + d]), np.int32)
                    flats.append(flat)
                    owners.append(np.full(len(flat), u))
                continue
            for at in range(0, len(own), 1 << 15):
                part = own[at : at + (1 << 15)]
                flat, count = self.split(arr[s[part][:, None] + np.arange(d)])
                flats.append(flat)
                owners.append(np.repeat(part, count))
        flat, owner = np.concatenate(flats), np.concatenate(owners)
        flat = flat[np.argsort(owner, kind="stable")]
        count = np.bincount(owner, minlength=len(size))
        begin = np.cumsum(count) - count
        total = np.concatenate(([0], np.cumsum(count[which])))
        per_text = total[np.searchsorted(starts, first + sizes)] - total[np.searchsorted(starts, first)]
        return flat[spread(begin[which], count[which])], per_text




_HELD: dict = {}


def _held(sent) -> Automaton:
    """One automaton in a Python worker, whatever number of tasks it runs."""
    v = sent.value
    if _HELD.get("of") != v:
        _HELD.update(of=v, automaton=Automaton(v))
    return _HELD["automaton"]


def _lists(flat: np.ndarray, count: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    at = pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets)
    return pa.ListArray.from_arrays(at, pa.array(flat, pa.int32()))


def _encode(sent, k: int, back: bool):
    """Column k is the text; ids (and what they give) are put behind the columns."""

    def run(batches):
        automaton, decoded = _held(sent), sent.value.decoded
        for batch in batches:
            far = np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(far, (far[at - 1] if at else 0) + BATCH, "right")))
                part = batch.slice(at, to - at)
                own = part.column(k).cast(pa.binary()).to_pylist()
                null = np.array([x is None for x in own])
                flat, count = automaton.encode([x or b"" for x in own])
                new = [_lists(flat, count, null)]
                if back:
                    end = np.cumsum(count).tolist()
                    new.append(pa.array([None if x is None else decode_ids(flat[e - n : e].tolist(), decoded) for x, e, n in zip(own, end, count.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, "ids", "decoded"][: len(part.columns) + len(new)])
                at = to

    return run


def decode_ids(ids: list[int], decoded: tuple) -> str:
    """The text of ids; the space in front is dropped."""
    return b"".join([decoded[i] for i in ids])[1:].decode("utf-8", "replace")


def _decode(sent, ids_col: str):
    def run(batches):
        decoded = sent.value.decoded
        for batch in batches:
            col = batch.column(batch.schema.names.index(ids_col))
            flat, at = col.values, col.offsets.to_pylist()
            out = [decode_ids(flat[a:b].to_pylist(), decoded) if ok else None for a, b, ok in zip(at, at[1:], col.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def _encoded(df: DataFrame, cols: list[str], text_col: str, model: str, back: bool) -> DataFrame:
    """c0, c1, ... (the columns `cols`), ids and, with `back`, decoded."""
    sent = df.sparkSession.sparkContext.broadcast(load(model))
    rows = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return in_arrow(rows, _encode(sent, cols.index(text_col), back), extended(rows.schema.fields, "ids array<int>" + ", decoded string" * back))


def encode(df: DataFrame, text_col: str = "text", model: str = MODEL, back: bool = False) -> DataFrame:
    """df with ids array<int>: the split of each text with the highest sum of scores; with `back` also decoded, what the ids give.

    Of equally good splits that whose last piece is longer wins, at each position. A
    null text has null ids, an empty one none. Any other text is split with a space in
    front, unchanged otherwise; a character without a piece becomes its bytes, as does
    a literal U+2581, so decoding gives every text back. Columns named ids (and, with
    `back`, decoded) are replaced. An empty table gives no rows.
    """
    new = ["ids", "decoded"][: 1 + back]
    kept = [c for c in df.columns if c not in new]
    cols = kept if text_col in kept else [*kept, text_col]
    found = _encoded(df, cols, text_col, model, back)
    return found.select(*[F.col(f"c{cols.index(c)}").alias(c) for c in kept], *new)


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df with decoded string. Null ids give null; ids that no text has may give bytes that are no UTF-8, which become U+FFFD. A column named decoded is replaced."""
    sent = df.sparkSession.sparkContext.broadcast(load(model))
    df = df.drop("decoded")
    return in_arrow(df, _decode(sent, ids_col), extended(df.schema.fields, "decoded string"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the decoded ids equal the text; null for a null text)."""
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), back=True)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", (F.col("text") == F.col("decoded")).alias("round_trip"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their token ids; the text is what the ids decode to.

    ids and n_tokens are put behind the columns of docs; a column that has such a name
    keeps it and its values, and the new one is called tokens_ids or tokens_n_tokens. Null
    texts stay, with null ids; an empty table gives no rows.
    """
    cols = docs.columns
    taken = {c.lower() for c in cols}
    name = lambda c: fresh(f"tokens_{c}", cols) if c in taken else c
    found = _encoded(docs, cols, "text", MODEL, True)
    kept = [F.col("decoded" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(cols)]
    return found.select(*kept, F.col("ids").alias(name("ids")), F.size("ids").cast("bigint").alias(name("n_tokens")))
