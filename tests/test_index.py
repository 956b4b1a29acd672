import pytest
from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import index, search
from weft.plans import inspect
from weft.sources import index_text

DOCS = [(1, "mystery book summary"), (2, "book book history"), (3, None), (4, "the of"), (5, "mystery summary of a book")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build_and_merge(spark, docs):
    whole = index.build_index(docs)
    assert ("book", 2, 2) in rows(whole) and ("mystery book summary", 1, 1) in rows(whole)
    parts = [index.build_index(docs.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    assert rows(index.merge_index(*parts)) == rows(index.merge_index(*parts[::-1])) == rows(whole)
    assert rows(index.build_index(docs.limit(0))) == []
    assert rows(index.build_index(docs, only=["book", "book book"])) == [r for r in rows(whole) if r[0] in ("book", "book book")]


def test_text_formats(spark):
    lines = spark.createDataFrame([("check stuff | 1 | u1", 1), ("check stuff | 3 | u1", 2), ("check | 2 | u2", 3)], "value string, n bigint")
    local = index_text.parse_local(lines)
    assert rows(local) == [("check", "u2", 2), ("check stuff", "u1", 3)]  # the last line of a pair wins
    held = index_text.parse_global(spark.createDataFrame([("check | u2 2  u1 1",), ("new | u9 4",)], "value string"))
    merged = index.merge_index(local, held, doc="url")
    got = {r.term: r.line for r in index_text.global_lines(merged).collect()}
    assert got == {"check": "check | u2 4 u1 1", "check stuff": "check stuff | u1 3", "new": "new | u9 4"}


def test_written_index(spark, docs, tmp_path):
    path = str(tmp_path / "idx")
    index.write_index(index.build_index(docs), path, shards=4)
    assert rows(index.read_index(spark, path)) == rows(index.build_index(docs).select("term", "doc_id", "cnt"))
    some = index.read_index(spark, path, ["book", "history"])
    assert rows(some) == [("book", 1, 1), ("book", 2, 2), ("book", 5, 1), ("history", 2, 1)]
    assert any("term" in p for p in inspect.pushed_filters(some)) and any("shard" in p for p in inspect.partition_filters(some))
    assert inspect.shuffles(some) == 0


def test_cached_index(spark, docs, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def build():
        calls.append(1)
        return index.build_index(docs)

    for config, n in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        index.cached_index(spark, path, config, build)
        assert len(calls) == n


def test_postings_and_stats(spark, docs):
    idx = index.build_index(docs)
    got = {r.term: [tuple(p) for p in r.postings] for r in index.posting_lists(idx).collect()}
    assert got["book"] == [(2, 2), (1, 1), (5, 1)]
    assert index.index_stats(docs, idx).first().asDict() == {"docs": 5, "docs_with_terms": 3, "terms": len(got)}
    top = index.top_terms(idx, 1).where("doc_id = 2").first()
    assert (top.term, top.cnt, top.rnk) == ("book", 2, 1)


def test_search(spark, docs):
    idx = index.build_index(docs)
    assert [tuple(r) for r in search.search(idx, "Books", limit=2).collect()] == [(1, 2, 2), (2, 1, 1)]
    assert [tuple(r) for r in search.search(idx, "mystery book").collect()] == [(1, 1, 3), (2, 2, 2), (3, 5, 2)]
    assert search.search(idx, "the of").count() == 0 and search.search(idx, "book", limit=0).count() == 0
    assert rows(search.search_documents(docs, "mystery book")) == rows(search.search(idx, "mystery book"))
    with pytest.raises(ValueError):
        search.search(idx, "book", limit=-1)
    assert search.checked_limit("x") == search.checked_limit(None) == 20
    assert search.query_text("a", ["b", "c"]) == "b c" and search.query_text(["a", "b"], ["c"]) == "a b"
    assert search.search_terms("a b c books") == ["b c book", "b", "c", "book"]
    asked = spark.createDataFrame([(7, "history books"), (8, None)], "item_id bigint, text string")
    assert rows(search.search_many(idx, asked).select("item_id", "rnk", "doc_id", "score")) == [(7, 1, 2, 3), (7, 2, 1, 1), (7, 3, 5, 1)]


def test_postings_without_document_or_count(spark):
    idx = spark.createDataFrame([("a", "u", None), ("a", None, 5), ("a", "v", 2)], "term string, doc_id string, cnt bigint")
    assert [tuple(r) for r in search.rank(idx, 5).collect()] == [(1, "v", 2), (2, "u", 0)]
    assert [r.doc_id for r in search.rank(idx, 5, collation="UNICODE").collect()] == ["v", "u"]


def test_substring_search(spark):
    idx = spark.createDataFrame([("start up", 1, 1), ("arts", 1, 1), ("other", 1, 1)], "term string, doc_id bigint, cnt bigint")
    assert rows(search.substring_search(idx, "art").select("term")) == [("arts",), ("start up",)]


def test_search_plan(spark, tmp_path, docs):
    path = str(tmp_path / "p")
    index.build_index(docs).write.parquet(path)
    df = search.search(spark.read.parquet(path), "book history")
    plan = inspect.physical(df)
    assert "TakeOrderedAndProject" in plan and not inspect.runs_python(df)
    assert any("In(term" in p for p in inspect.pushed_filters(df))


def test_placement(spark):
    """Published ids of one key over three local nodes."""
    low = [hashing.node_id("127.0.0.1", 10000 + i) for i in range(3)]
    high = [hashing.node_id("127.0.0.1", 20000 + i) for i in range(3)]
    kid = F.lit(hashing.content_id_of("jcarb"))
    got = spark.range(1).select(hashing.naive_hash(kid, low).alias("n"), hashing.consistent_hash(kid, low).alias("c"), hashing.rendezvous_hash(kid, high).alias("r")).first()
    assert got.n == "8df6d087feed28c8a46dbd0fba5413e59e2d4c537aad8efff54d7b3ec62b0511"
    assert got.c == "8970c41015d3ccbf1f46691ae77ab225aa6c3d401f6c1c5297f4df7ec35c72b0"
    assert got.r == "2f29d190dcd1d1e835881ecef3cd06edfb89db1d81676ef52587d4065e24b915"
    keys = spark.range(50).select(hashing.content_id(F.col("id").cast("string")).alias("k"))
    for h in hashing.HASHERS.values():  # the order of the list is no matter
        assert keys.where(h(F.col("k"), low) != h(F.col("k"), low[::-1])).count() == 0
    short = [hashing.short_id(n) for n in low]
    assert {r[0] for r in keys.select(hashing.consistent_hash(F.col("k"), short)).collect()} == {min(short)}  # every key lies above all short ids


def test_content_id(spark):
    got = spark.createDataFrame([('a"b',), ("",), (None,)], "v string").select(hashing.content_id(F.col("v"))).collect()
    assert [r[0] for r in got] == [hashing.content_id_of(v) for v in ('a"b', "", None)]
