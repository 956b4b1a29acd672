"""The near-duplicate stage of the pipeline against five-word shingles compared pair by pair."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_others import hits
from tests.llm.test_pipeline import trimmed
from weft.llm import language, similar
from weft.llm.simhash import Forest

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of(docs):
    """Of (id, text), ids ascending, the smallest id reachable by pairs of similarity 0.8 or more, for each."""
    sets, up, held = [shingle_set(t) for _, t in docs], list(range(len(docs))), {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for g in s or {()}:
            for j in held.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            held[g].append(i)
        for j, n in common.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {d: docs[root(i)][0] for i, (d, _) in enumerate(docs)}


def planted():
    """Texts of many lengths, each with copies edited a little more or less than the rule allows, and a chain."""
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(0, 100_000)}"
    out = []
    for n in [1, 3, 5, 6, 8, 9, 12, 18, 24, 30, 60, 64, 120, 400] * 3:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for edits in (0, 1, n // 60 + 1, n // 40 + 1, n // 15 + 1):
            copy = list(base)
            for at in r.integers(0, n, edits):
                copy[at] = word()
            out += [" ".join(copy).upper(), "  ".join(copy[: n - n // 6]), " ".join([word(), *base])]
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = [*chain[9:], *(word() for _ in range(9))]
        out.append(" ".join(chain))
    line = " ".join(word() for _ in range(30))
    out += [f"{line} {' '.join(word() for _ in range(int(k)))}" for k in r.integers(3, 40, 150)]
    return [(i, out[k]) for i, k in enumerate(r.permutation(len(out)).tolist())]


def test_stage_keeps_one_of_similar_texts(spark, sf):
    docs = planted()
    of = first_of(docs)
    assert 100 < len(set(of.values())) < 0.7 * len(docs)
    got = STAGE(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(of.values()))


def test_stage_on_the_documents(spark, db, sf):
    docs = db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = STAGE(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(first_of(docs).values()))


def test_stage_on_awkward_rows(spark, awkward, none, sf):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in STAGE(spark, awkward.fillna("", ["text"]), sf).collect())
    assert [g[:2] for g in got] == [(False, 0), (True, 2), (True, 3), (True, 6), (True, 7), (True, 8), (True, 9)]
    assert STAGE(spark, none, sf).count() == 0


def test_candidates_of_large_buckets(monkeypatch):
    """Every link of similar texts lies within a component of candidates, however large buckets are."""
    monkeypatch.setattr(similar, "TILE", 8)
    docs = planted()
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["node", "text"])
    entries = list(similar._entries(SimpleNamespace(value=np.zeros(0, np.uint64)))([batch]))
    forest = Forest(len(docs))
    for x in similar._meet(entries):
        forest.link(np.asarray(x.column(0)), np.asarray(x.column(1)))
    roots = forest.roots(np.arange(len(docs)))
    assert all(roots[d] == roots[c] for d, c in first_of(docs).items())


def test_pipeline_keeps_no_similar_texts(spark, db, sf):
    docs = {d: t for d, t in db.execute("SELECT doc_id, text FROM documents").fetchall() if language.has_letter(t)}
    of = first_of(sorted(docs.items()))
    docs = trimmed({d: t for d, t in docs.items() if of[d] == d})
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = {d: t for d, t in docs.items() if not hits(t, items)[1]}
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, sf).collect()} == docs


def test_texts_that_share_a_hash_are_told_apart(spark):
    """Names from a hash that is the text's length: every clash is resolved by the second one."""
    from pyspark.sql import functions as F

    from weft.llm import similar as module

    rows = [(i, t) for i, t in enumerate(["ab", "cd", "ab", "ef", "x", "", None, " \n", "y", "abc"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for first in (F.length(F.coalesce("text", F.lit(""))).cast("bigint"), F.lit(7).cast("bigint")):
        named = module.with_names(df, "text", "node", lambda t, f=first: (F.when(F.trim(F.coalesce(F.regexp_replace(t, "\n", ""), F.lit(""))) == "", F.lit(0).cast("bigint")).otherwise(f), module._hashes(t)[1]))
        by = {}
        for r in named.collect():
            by.setdefault(r.node, set()).add(r.text if r.text and r.text.strip() else "")
        assert named.columns == ["doc_id", "text", "node"] and sorted(map(sorted, by.values())) == [[""], ["ab"], ["abc"], ["cd"], ["ef"], ["x"], ["y"]]


def test_unlike_texts_of_a_bucket_are_no_candidates():
    """Texts with one shingle in common and hardly another, too few a task to be a crowd, are no component, however many they are."""
    import xxhash

    r = np.random.default_rng(7)
    line = next(x for x in (f"w{k} a b c d" for k in range(10**6)) if xxhash.xxh64_intdigest(x.encode(), 42) < 1 << 52)  # first in any order
    texts = [f"{' '.join(f'w{w}' for w in r.integers(0, 10**6, 60))} {line}" for _ in range(400)]
    texts.append(texts[0] + " end")
    entries = similar._entries(SimpleNamespace(value=np.zeros(0, np.uint64)))
    batches = [x for k in range(0, len(texts), 8) for x in entries([pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 8, len(texts)))), pa.array(texts[k : k + 8])], names=["node", "text"])])]
    forest = Forest(len(texts))
    for x in similar._meet(batches):
        forest.link(np.asarray(x.column(0)), np.asarray(x.column(1)))
    roots = forest.roots(np.arange(len(texts)))
    assert roots[400] == roots[0] and np.bincount(roots).max() <= 4


def test_components_of_many_tiles(spark, sf, monkeypatch):
    """Texts that repeat themselves are sent as their shingles, and every two tiles of a component still meet."""
    monkeypatch.setattr(similar, "TILE_BYTES", 2000)
    monkeypatch.setattr(similar, "TEXT_BYTES", 0)
    r = np.random.default_rng(11)
    over = [" ".join(f"v{w}" for w in r.integers(0, 3, 2) for _ in range(int(r.integers(20, 400)))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(over + [t for _, t in planted()[:150]])]
    of = first_of(docs)
    got = STAGE(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), sf)
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(of.values()))
    one = pa.array([1] * 2)
    sent = list(similar._packed([pa.RecordBatch.from_arrays([one, one, one, pa.array([True, False]), pa.array([over[0]] * 2)], names=["component", "node", "g", "wide", "text"])]))[0]
    assert sent.column(4).to_pylist() == [True, False]
    assert len(sent.column(3)[0].as_py()) == 8 * len(shingle_set(over[0])) and sent.column(3)[1].as_py().decode() == over[0]
