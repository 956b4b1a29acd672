"""How much an index moves: rows are formed where they are needed, and are the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.operators import index, pieces, served
from weft.plans import inspect
from weft.sources import index_text
from weft.streaming import index_stream


def rows(df, *columns):
    return sorted(map(repr, (df.select(*columns) if columns else df).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, " ".join(f"w{'abcdefg'[(i * k) % 7]}" for k in range(i % 9))) for i in range(60)]
    return spark.createDataFrame([*made, (3, "wa wb wa"), (None, "wb wc"), (70, None), (71, "the of")], "doc_id bigint, text string")


@pytest.mark.parametrize("frequent", [20, 1000])
def test_index_by_first_words(docs, frequent):
    """One shuffle of words, and the rows of the plain way, frequent first words or not."""
    plain = index.build_index(docs)
    held = index.over_terms(docs, index.ranked_postings, frequent=frequent)
    assert frequent == 20 or inspect.shuffles(held) == 1
    assert rows(held) == rows(index.ranked_postings(plain))
    for made in (lambda own: index_text.line_chunks(own, "doc_id", 5), lambda own: index_text.global_lines(own.where("doc_id IS NOT NULL"), "doc_id")):
        got = index.over_terms(docs, made, frequent=frequent)
        assert frequent == 20 or inspect.shuffles(got) == 1
        assert rows(got) == rows(made(plain), *got.columns)


def shards_of(path):
    return [[f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")] for d in os.listdir(path) if d.startswith("shard=")]


def test_written_where_it_is(spark, docs, tmp_path):
    """Several tasks write to a shard, as no row is dealt by shard."""
    at = str(tmp_path)
    index.write_index(index.build_index(docs, tasks=4), f"{at}/i", 1, files=None)
    assert len(shards_of(f"{at}/i/postings")[0]) > 1 and rows(index.read_index(spark, f"{at}/i")) == rows(index.build_index(docs))


def test_served_where_it_is(spark, docs, tmp_path):
    served.write_served(docs, str(tmp_path / "s"), shards=1, segment=2)
    assert len(shards_of(str(tmp_path / "s/blocks"))[0]) > 1
    own = served.read_served(served.open_served(spark, str(tmp_path / "s")))
    assert rows(own) == rows(index.build_index(docs.where("doc_id IS NOT NULL")))


def test_pieces_where_they_are(spark, docs, tmp_path):
    pieces.write_substring_index(index.index_by_head(docs), str(tmp_path / "p"), shards=1)
    pairs = spark.read.parquet(str(tmp_path / "p/terms"))
    assert len(shards_of(str(tmp_path / "p/terms"))[0]) > 1 and pairs.count() == pairs.distinct().count()
    want = index.build_index(docs).where(F.contains("term", F.lit("b w")))
    assert rows(pieces.substring_search(spark, str(tmp_path / "p"), "b w"), *want.columns) == rows(want)


@pytest.mark.parametrize("told", [0, 1000])
def test_maintained_sums_only_what_came_again(spark, docs, tmp_path, told, monkeypatch):
    monkeypatch.setattr(index_stream, "TOLD", told)
    at = str(tmp_path / "m")
    index.build_index(docs.where("doc_id < 40")).write.parquet(f"{at}/batch=0")
    index.build_index(docs.where("doc_id >= 40 OR doc_id IS NULL")).write.parquet(f"{at}/batch=1")
    assert rows(index_stream.read_maintained(spark, at)) == rows(index.build_index(docs))
    assert told == 0 or inspect.shuffles(index_stream.read_maintained(spark, at)) == 0
    index.build_index(docs.where("doc_id = 5 OR doc_id IS NULL")).write.parquet(f"{at}/batch=2")
    twice = docs.unionByName(docs.where("doc_id = 5 OR doc_id IS NULL"))
    assert rows(index_stream.read_maintained(spark, at)) == rows(index.build_index(twice))


def test_merge_in_bounded_tasks(spark, monkeypatch):
    """Tasks follow the number of documents, so that no task's maps grow with the table."""
    monkeypatch.setattr(index, "TASK_DOCS", 10)
    assert catalog.index_merge(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 20


def test_local_lines_are_written_compressed(spark):
    held = catalog.local_index_read(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".gz") for f in held.inputFiles())
