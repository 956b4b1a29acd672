import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm.class_lm")
from weft.llm import class_lm
from weft.llm.queries import QUERIES

END = "</s>"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, classes_of, classes):
    """(n_tokens, n_known, N, base, score) of rows (text, learns), from the class of every known word."""
    train = [[*words(t), END] for t, learns in rows if learns]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    cls = lambda w: ("?" if w not in count else END if w == END else classes_of[w])
    size = Counter()
    for w, c in count.items():
        size[cls(w)] += c
    after, total, once = defaultdict(Counter), Counter(), Counter()
    for t in train:
        for a, b in zip([END, *t], t):
            for x in [cls(a)] + ["?"] * (count[a] == 1 and a != END):
                after[x][cls(b)] += 1
                total[x] += 1
                once[x] += count[b] == 1 and b != END
    rate = (sum(o for x, o in once.items() if x != "?") + 0.5) / (n + 1)
    prior = {c: (s + 1) / (n + len(size)) for c, s in size.items()}
    e = lambda x: (once[x] + rate) / (total[x] + 1)

    def prob(a, b):
        x = cls(a)
        if b not in count:
            return e(x)
        return (1 - e(x)) * (after[x][cls(b)] + 8.0 * prior[cls(b)]) / (total[x] + 8.0) * count[b] / size[cls(b)]

    out = []
    for t, _ in rows:
        own = [*words(t), END]
        out.append((len(own), sum(w in count for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), sum(math.log10(prob(a, b)) for a, b in zip([END, *own], own))))
    return out, prob, count


def classes_of(df, learns, **options):
    return {r.word: r["class"] for r in class_lm.cluster_words(df, learns, **options).collect()}


@pytest.mark.parametrize("share", [class_lm.SHARE, 1e-3])
def test_query_rows_against_a_plain_model(spark, sf, monkeypatch, share):
    monkeypatch.setattr(class_lm.score_texts, "__defaults__", (*class_lm.score_texts.__defaults__[:3], share, 6))
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = table.collect()
    got = {r.doc_id: r for r in QUERIES["op12_class_lm"](spark, sf).collect()}
    own = classes_of(table, F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2"), share=share, rounds=6)
    want, prob, count = plain([(d.text, zlib.crc32(str(d.doc_id).encode()) % 7 != 2) for d in docs], own, 64)
    assert len(got) == len(docs) and set(own) | {END} == set(count)
    for d, (n, known, total, base, score) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d.doc_id).encode()) % 7 == 2, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-11) and math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.perplexity, 10 ** (-r.score / n), rel_tol=1e-9)
    for a in (END, docs[0].text.split()[0].lower(), "not a word"):
        assert math.isclose(sum(prob(a, b) for b in [*count, "not a word"]), 1, rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_gains_are_differences_of_the_likelihood():
    r = np.random.default_rng(0)
    m, k = 9, 4
    pairs = r.integers(0, 6, (m + 2, m + 2))
    of = np.append(r.integers(0, k, m), [k, k + 1])

    def matrix(of):
        out = np.zeros((k + 2, k + 2), np.int64)
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    for w in range(m):
        right = np.bincount(of, pairs[w], k + 2)
        left = np.bincount(of, pairs[:, w], k + 2)
        gain = class_lm.gains(matrix(of), k, of[w], right, left, int(pairs[w, w]))
        all_ = []
        for c in range(k):
            moved = of.copy()
            moved[w] = c
            all_.append(class_lm.likelihood(matrix(moved)))
        assert np.allclose(np.diff(gain), np.diff(all_))


def test_exchange_finds_classes(spark):
    """Three kinds of words that follow each other in turn; the rare ones are placed by their neighbours."""
    r = np.random.default_rng(3)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    texts = [" ".join(kinds[j % 3][int(12 * r.random() ** 2)] for j in range(30)) for _ in range(300)] + [f"a1 rare{i} c2" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    own = classes_of(df, F.lit(True), classes=3, share=1e-3, rounds=30)
    assert [len({own[w] for w in k}) for k in kinds] == [1, 1, 1]
    assert len({own[k[0]] for k in kinds}) == 3 and {own[f"rare{i}"] for i in range(5)} == {own["b0"]}


def test_rows_do_not_depend_on_blocks_or_tasks(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).cache()
    learns = F.col("doc_id") % 3 != 0
    score = lambda d: {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score_texts(d, learns, classes=8, share=1e-3, rounds=3).collect()}
    one = score(df.coalesce(1))
    monkeypatch.setattr(class_lm, "BLOCK", 3000)
    monkeypatch.setattr(class_lm, "PAIRS", 500)
    assert score(df.repartition(7)) == one


def test_high_counts_in_a_block(spark):
    """A word beside the frequent ones with more neighbours of one class than an entry counts."""
    df = spark.createDataFrame([(0, "x y " * 70_000), (1, "z")], "doc_id bigint, text string")
    got = {r.word: r.cnt for r in class_lm.cluster_words(df, F.lit(True), classes=2, share=0.6).collect()}
    assert got == {"x": 70_000, "y": 70_000, "z": 1}


def test_awkward_rows(spark, awkward, none):
    rows = awkward.collect()
    learns = F.col("lang") == "en"
    got = class_lm.score_texts(awkward.withColumns({"score": F.lit(1), "a-b `c": F.lit(2)}), learns, classes=5).collect()
    train = [w for r in rows if r.lang == "en" for w in [*words(r.text), END]]
    count = Counter(train)
    want = []
    for r in rows:
        own = [*words(r.text), END]
        base = sum(math.log10((count[w] + 1) / (len(train) + len(count) + 1)) for w in own)
        want.append((str(r.doc_id), r.lang != "en", len(own), sum(count[w] > 0 for w in own), len(train), round(base, 3)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score_texts(none, learns).count() == 0
    nothing = class_lm.score_texts(awkward, F.lit(None).cast("boolean")).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in nothing} == {(0, 0, 0.0)} and all(math.isclose(r.score, r.n_tokens * math.log10(0.5)) for r in nothing)
    only_ends = class_lm.score_texts(spark.createDataFrame([("x", ""), ("y", None)], "doc_id string, text string"), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in only_ends} == {(1, 2)}
    with pytest.raises(ValueError):
        class_lm.score_texts(awkward, learns, classes=0)


def test_tokens_are_runs_without_ascii_space():
    texts = ["A b\x1cc d  E\x0b\x0c\r\nÄ", None, "", " \t", "x" * 100_000, "Straße STRASSE"]
    own, n = class_lm.tokens(pa.array(texts, pa.string()))
    flat = own.to_pylist()
    assert [flat[a : a + k] for a, k in zip(np.cumsum(n) - n, n)] == [words(t) for t in texts]
