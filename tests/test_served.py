import pytest
from pyspark.sql import functions as F

from weft.operators import index, pieces, search, served
from weft.plans import inspect
from weft.sources import index_text


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of very different lengths; "rare" is frequent in a few, "common" stands in all."""
    made = [(i, " ".join(["common"] * (1 + i % 5) + ["rare"] * (i % 97 == 0) * (i % 11 + 1) + [f"word{chr(97 + i % 26)}"] * (1 + i * i % 300))) for i in range(1500)]
    made += [(7, "common rare rare"), (None, "rare " * 50), (2000, None), (2001, ""), (2002, "the of")]
    return spark.createDataFrame(made, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def opened(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("served"))
    served.write_served(docs, path, shards=4, files=2, segment=16)
    return served.open_served(spark, path)


@pytest.fixture(scope="module")
def whole(docs):
    return index.build_index(docs).cache()


@pytest.mark.parametrize("query", ["rare", "rare common", "common common", "wordb worda rare", "nothing", "the of", None, "common common common common"])
@pytest.mark.parametrize("limit", [0, 3, 5000])
def test_hits_are_those_of_the_whole_index(whole, opened, query, limit):
    want = rows(search.search(whole, query, limit=limit))
    for options in ({}, {"first": 1}, {"first": 1, "bounds": 2}) if limit == 3 else ({},):
        assert rows(served.find(opened, query, limit=limit, **options).rows) == want


def test_segments_that_cannot_reach_the_score_are_not_read(docs, opened):
    few = served.find(opened, "rare", limit=3, first=1)
    assert 0 < few.read < few.segments
    whole = served.find(opened, "common", limit=5000)
    assert whole.read == whole.segments
    blocks = opened.of(["rare"])
    assert any("term" in p for p in inspect.pushed_filters(blocks)) and any("shard" in p for p in inspect.partition_filters(blocks)) and inspect.shuffles(blocks) == 0
    own = {(r.segment, d) for r in opened.blocks.collect() for d in [p.doc for p in r.postings]}
    assert len({d for _, d in own}) == len(own)  # a document lies in one segment


def test_blocks_hold_the_index(docs, opened):
    held = index.build_index(docs.where("doc_id IS NOT NULL"))
    assert sorted(rows(served.read_served(opened).select("term", "doc_id", "cnt"))) == sorted(rows(held))
    assert all(r.top == max(p.cnt for p in r.postings) for r in opened.blocks.collect())


def test_served_index_of_nothing(spark, docs, tmp_path):
    served.write_served(docs.limit(0), str(tmp_path / "x"))
    assert rows(served.find(served.open_served(spark, str(tmp_path / "x")), "rare").rows) == []


def test_served_index_of_named_documents(spark, tmp_path):
    df = spark.createDataFrame([("b", "x1 book"), ("a", "book book"), ("c", "book book")], "`my-id` string, body string")
    served.write_served(df, str(tmp_path / "x"), "my-id", "body", shards=2)
    assert rows(served.find(served.open_served(spark, str(tmp_path / "x")), "book").rows) == [(1, "a", 2), (2, "c", 2), (3, "b", 1)]


# ---- substrings


def test_substrings_through_pieces(spark, whole, tmp_path):
    path, held = str(tmp_path / "p"), whole
    pieces.write_substring_index(held, path, shards=3)
    for query in ("omm", "a", "are comm", "e c", "on rare word", "zzz", "", "a b c d", "rare rar"):
        assert sorted(map(str, rows(pieces.substring_search(spark, path, query)))) == sorted(map(str, rows(search.substring_search(held, query)))), query
    met = pieces.candidate_words(spark, path, "wordq", front=True, back=True)
    assert rows(met) == [("wordq",)] and any("piece" in p for p in inspect.pushed_filters(met)) and any("shard" in p for p in inspect.partition_filters(met))


def test_pieces_of_a_word(spark):
    df = spark.createDataFrame([("a",), ("aaaa",), ("abc",)], "word string")
    got = {r.word: r.p for r in df.select("word", pieces._pieces(F.col("word")).alias("p")).collect()}
    assert got == {w: pieces.pieces_of(f"^{w}$") for w in ("a", "aaaa", "abc")}


# ---- posting order


def test_a_long_list_is_ranked_in_slices(spark):
    """One term with a third of all rows, most of one count: no group of rows that a task ranks holds more than a part of it."""
    made = [("hot", i * 7 % 3001, 1 + (i % 100 == 0)) for i in range(3000)] + [(f"t{i % 900}", i, 1) for i in range(6000)] + [("hot", None, 1)]
    df = spark.createDataFrame(made, "term string, doc_id bigint, cnt bigint")
    got = sorted((r.rnk, r.doc_id) for r in index.ranked_postings(df).where("term = 'hot'").collect())
    want = sorted([(t, d, c) for t, d, c in made if t == "hot"], key=lambda r: (-r[2], r[1] is not None, r[1] or 0))
    assert got == [(i + 1, r[1]) for i, r in enumerate(want)]
    cut = df.withColumn("_s", index._slice_of(F.col("doc_id"), list(range(47, 3001, 47))))
    assert cut.where("term = 'hot'").groupBy("cnt", "_s").count().agg(F.max("count")).first()[0] < 100


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_ranks_of_names_and_of_insertion_order(spark, slices):
    made = [("t", f"d{i % 17}é", 1 + i % 3, 100 - i) for i in range(17)] + [("u", "x", 1, 1)]
    df = spark.createDataFrame(made, "term string, url string, cnt bigint, came bigint")
    by_name = [r.url for r in index.ranked_postings(df, "url", slices=slices).where("term = 't'").orderBy("rnk").collect()]
    assert by_name == [r[1] for r in sorted(made[:-1], key=lambda r: (-r[2], r[1]))]
    stable = [r.url for r in index.ranked_postings(df, "url", ["came"], slices).where("term = 't'").orderBy("rnk").collect()]
    assert stable == [r[1] for r in sorted(made[:-1], key=lambda r: (-r[2], r[3]))]
    assert index.ranked_postings(df.limit(0), "url").count() == 0


def test_lines_of_a_long_list(spark, tmp_path):
    df = spark.createDataFrame([("t", f"u{i}", i) for i in range(1, 26)] + [("s", "u1", 2)], "term string, url string, cnt bigint")
    got = {(r.term, r.part): r.line for r in index_text.line_chunks(df, chunk=10).collect()}
    assert {k: (len(v.split()) - 2) // 2 for k, v in got.items()} == {("t", 0): 10, ("t", 1): 10, ("t", 2): 5, ("s", 0): 1} and got[("t", 0)].startswith("t | u25 25 u24 24")
    index_text.write_global(df, str(tmp_path / "x"), chunk=10)
    assert sorted(rows(index_text.read_global(spark, str(tmp_path / "x")))) == sorted(rows(df))
    stable = index_text.line_chunks(df.withColumns({"cnt": F.lit(1).cast("bigint"), "came": -F.col("cnt")}), order=["came"]).where("term = 't'").first()
    assert stable.line.startswith("t | u25 1 u24 1")


def test_a_changed_corpus_is_built_anew(spark, tmp_path):
    one = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    prints = [index.corpus_fingerprint(d) for d in (one, one.repartition(3), one.where("doc_id < 3"), one.replace("", "x"), one.unionByName(one.limit(1)), one.limit(0))]
    assert prints[0] == prints[1] and len(set(prints)) == 5
    swapped = spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id bigint, text string")
    nulls = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert len({prints[0], index.corpus_fingerprint(swapped), index.corpus_fingerprint(nulls)}) == 3
