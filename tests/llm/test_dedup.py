import hashlib
import random

import numpy as np
import pytest

from weft.llm import substring_dedup, suffix_dedup
from weft.llm.queries import QUERIES


def words_left(docs, n=50):
    """Brute force: (words, removed, kept) by document."""
    first, held = {}, []
    for d, t in docs:
        w = (t or "").encode().split()
        held.append((d, w))
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in held:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def bytes_left(docs, n=100):
    seen, out = set(), []
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def documents(db):
    return db.execute("SELECT doc_id, text FROM documents").fetchall()


def test_substring_query(spark, db, sf):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, sf).collect())
    assert got == words_left(documents(db)) and sum(r[2] for r in got) > 0


def test_suffix_query(spark, db, sf):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_array_dedup"](spark, sf).collect())
    assert got == bytes_left(documents(db)) and sum(r[2] for r in got) > 0


def planted(seed):
    """Texts made of few pieces, so that repeats start, end and overlap everywhere."""
    r = random.Random(seed)
    pieces = [" ".join(r.choice(["aa", "b", "cé", "ddd"]) for _ in range(r.randint(5, 40))) for _ in range(6)]
    return [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 12)))) for i in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed, monkeypatch):
    docs = planted(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_repeats(df).collect())
    assert got == words_left(docs)
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == bytes_left(docs)


def test_awkward_rows(spark, awkward, none):
    found = {(r.doc_id, r.n_words): r for r in substring_dedup.remove_repeats(awkward).collect()}
    assert len(found) == 11  # all but the repeated row
    removed = {k: sum(s.end - s.start for s in r.spans) for k, r in found.items()}
    assert removed[(None, 120)] == 0 and removed[(1, 120)] == 120 and removed[(2, 120)] == 120 and removed[(3, 0)] == removed[(4, 0)] == removed[(5, 0)] == 0
    assert removed[(6, 30_000)] == 0 and removed[(7, 30_001)] == 30_000
    found = suffix_dedup.remove_repeats(awkward, keep=["h", "source"]).collect()
    assert len(found) == awkward.count()
    by = {(r.doc_id, r.h): r for r in found}
    assert by[(3, None)].no_text and by[(3, None)].n_bytes == 0 and not by[(4, 0)].no_text
    assert by[(6, 4)].kept == b"b "  # only two windows are new, and the others cover all but two bytes
    assert by[(7, 4)].kept == b"c"
    assert len(by[(2, 2)].kept) == 0 and by[(2, 8)].kept.decode() == "another text under the same id"
    assert substring_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == 0


def test_difference_cover(monkeypatch):
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    r = random.Random(5)
    for size in (8, 1 << 18):
        monkeypatch.setattr(suffix_dedup, "RANGE", size)
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(20, 40))) for _ in range(3)]
        text = b"".join(r.choice(pieces) for _ in range(50))
        n, starts = 33, np.arange(len(text) - 32)
        cls = suffix_dedup.window_classes(np.frombuffer(text, np.uint8), n, starts)
        of: dict = {}
        for i in starts.tolist():
            of.setdefault(text[i : i + n], set()).add(int(cls[i]))
        assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)
        keys = suffix_dedup.eights(np.frombuffer(text, np.uint8), 64)
        rank = suffix_dedup.cover_ranks(keys, len(text))
        cover = [i for i in range(len(text)) if i % suffix_dedup.PERIOD in suffix_dedup.COVER]
        assert sorted(cover, key=lambda i: rank[i]) == sorted(cover, key=lambda i: text[i:])
        order, _ = suffix_dedup.sort_range(np.arange(len(text) - 16), keys, lambda: rank)
        ties: dict = {}
        for i in order.tolist():
            ties.setdefault(text[i : i + 16], []).append(i)
        assert all(x == sorted(x, key=lambda i: text[i:]) for x in ties.values() if len(x) > 2)


def removed(found):
    return sorted((r[0], [(s.start, s.end) for s in r.spans]) for r in found.collect())


def test_the_kernels_decide(spark):
    """With a kernel that finds nothing the results are others."""
    df = spark.createDataFrame(planted(1), "doc_id bigint, text string").repartition(5)
    assert not any(s for _, s in removed(substring_dedup.remove_repeats(df, find=lambda hits, starts, *_: starts[:0])))
    assert removed(suffix_dedup.remove_repeats(df, classes=lambda text, n, starts: np.arange(len(starts)))) != removed(suffix_dedup.remove_repeats(df))


def thue_morse(n):
    """Two different words of 2**n letters whose polynomial hashes modulo 2**64 agree for every odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide(spark):
    a, b = thue_morse(10)
    df = spark.createDataFrame([(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([b] * 60))], "doc_id bigint, text string")
    assert removed(substring_dedup.remove_repeats(df)) == [(1, []), (2, []), (3, [(0, 60)])]
    docs = [(1, a * 2), (2, b * 2), (3, b * 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == bytes_left(docs)


@pytest.mark.parametrize("hot", [0, 2])
def test_many_small_blocks_and_hot_anchors(spark, hot, monkeypatch):
    """Strings of hot anchors are dealt out alone; the sort works in small pieces."""
    docs = planted(3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(23)
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, hot=hot).collect())
    assert got == bytes_left(docs)


def test_equal_hashes_are_compared_byte_by_byte():
    text = np.frombuffer(b"abcabcabdabc", np.uint8)
    lo, size = np.array([0, 3, 6, 9]), np.full(4, 3)
    order, head = np.arange(4), np.array([True, False, False, False])
    assert suffix_dedup.distinct(text, lo, size, order, head).tolist() == [0, 0, 2, 0]


def test_blocks_hold_all_rows(spark, monkeypatch):
    from weft.llm import exchange

    df = spark.createDataFrame([(f"text {i} " * (i % 50), i, None if i % 7 else "x") for i in range(500)], "text string, id bigint, more string").repartition(3)
    got = exchange.blocks(df)
    rows = [x for r in got.collect() for x in exchange.read_batch(r.data).to_pylist()]
    assert sorted(x["id"] for x in rows) == list(range(500)) and all(x["text"] == f"text {x['id']} " * (x["id"] % 50) for x in rows)
    monkeypatch.setattr(exchange, "BLOCK", 1000)
    batch = df.toArrow().to_batches()
    from types import SimpleNamespace

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    made = list(exchange._deal(batch))
    assert len(made) > 50 and sum(exchange.read_batch(b.column(2)[0].as_py()).num_rows for b in made) == 500
    assert len({b.column(0)[0].as_py() for b in made}) == len(made)


def test_joined_spans():
    from weft.llm.exchange import joined_spans

    got = joined_spans(np.array([2, 0, 0, 0, 2]), np.array([5, 10, 0, 8, 0]), np.array([9, 12, 20, 9, 5]), 3)
    assert got == [[(0, 20)], [], [(0, 9)]]
