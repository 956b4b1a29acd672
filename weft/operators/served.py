"""Ranked search of a written index that reads only the postings that can matter.

Documents are dealt into segments by their length, so that those with high counts lie
together, and a term's postings are written in blocks, one a segment, each with its
highest count. The sum of a query's highest counts in a segment bounds the score of every
document in it, and the k-th of the segments' single highest counts bounds the k-th score from below. A
search reads these bounds and scores only segments whose bound reaches that score.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weft.functions.text import STOP_WORDS, ngram_bag, terms
from weft.operators.index import read_manifest, shard_number, shard_of_literal, tasks_of
from weft.operators.search import DEFAULT_LIMIT, checked_limit, rank, search_terms, top_scores

#: Documents of a segment, about.
SEGMENT = 64
#: Segments that are scored first, and the most bounds that come to the driver.
FIRST, BOUNDS = 64, 4096
#: The most rows of a result that are numbered on the driver.
LISTED = 10_000


def segment_of(size: Column, doc: Column, spread: int) -> Column:
    """Half octaves of a document's size, each dealt into `spread` by a hash of the document: a function of the document alone."""
    return F.floor(F.log2(size + 1) * 2) * spread + F.pmod(F.xxhash64(doc), F.lit(spread))


def write_served(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", shards: int = 64, files: int | None = None, segment: int = SEGMENT, stop_words: Sequence[str] = STOP_WORDS) -> None:
    """The n-gram index of docs (doc, text) as blocks: a directory a shard, terms in order inside each file; a manifest beside it.

    Texts are shuffled twice before they are taken apart: by document, as rows that share an id are one
    document, and by segment. So counts and blocks are formed where a segment's texts are, and each task adds
    its blocks to every shard; with `files` blocks are shuffled into so many a shard.
    Documents without an id are left out, as no search finds them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    spread = max(1, rows.count() // (8 * segment))  # a half octave holds about an eighth of all documents
    sized = rows.withColumn("size", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("doc")))
    dealt = sized.select("doc", "text", segment_of(F.col("size"), F.col("doc"), spread).alias("segment")).repartition(tasks_of(rows), "segment")
    found = dealt.select("doc", "segment", F.explode(ngram_bag(terms(F.col("text"), stop_words))).alias("term"))
    counts = found.groupBy("segment", "term", "doc").agg(F.count(F.lit(1)).alias("cnt"))
    blocks = counts.groupBy("term", "segment").agg(F.max("cnt").alias("top"), F.collect_list(F.struct("doc", "cnt")).alias("postings"))
    placed = blocks.select(shard_number(F.col("term"), shards).alias("shard"), "term", "segment", "top", "postings")
    if files is not None:
        placed = placed.repartition(F.col("shard"), F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(files)))
    ordered = placed.sortWithinPartitions("shard", "term", "segment")
    ordered.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")
    manifest = {"shards": shards, "spread": spread, "doc": doc, "schema": ordered.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


@dataclass
class Served:
    """An opened index: its files are listed and its schema is read once, for any number of searches."""

    blocks: DataFrame
    shards: int
    doc: str

    def of(self, wanted: Sequence[str]) -> DataFrame:
        """The blocks of some terms: their shards are listed, the terms pushed to the scan."""
        shards = sorted({shard_of_literal(t, self.shards) for t in wanted})
        return self.blocks.where(F.col("shard").isin(shards) & F.col("term").isin(list(wanted)))


@dataclass
class Hits:
    """rows (rnk, doc, score); segments that hold a term of the query, and those of them whose postings were read."""

    rows: DataFrame
    segments: int
    read: int


def open_served(spark: SparkSession, path: str) -> Served:
    held = read_manifest(spark, path)
    return Served(spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{path}/blocks"), held["shards"], held["doc"])


def read_served(index: Served) -> DataFrame:
    """(term, doc, cnt) of the whole index."""
    return index.blocks.select("term", F.inline("postings")).withColumnRenamed("doc", index.doc)


def _scores(blocks: DataFrame, doc: str) -> DataFrame:
    return blocks.select(F.inline("postings")).select(F.col("doc").alias(doc), "cnt")


def find(index: Served, query=None, terms_: Sequence[str] | None = None, limit: int = DEFAULT_LIMIT, stop_words: Sequence[str] = STOP_WORDS, first: int = FIRST, bounds: int = BOUNDS) -> Hits:
    """The same rows as search() over the whole index.

    A segment is skipped if its bound lies below the k-th score of those read: a
    document there can't reach it, and one with that very score isn't skipped, as it may
    win by its id. Where more than `bounds` segments could matter, those that reach the k-th score
    are joined by Spark and not listed; the rows are the same.
    """
    k, spark, doc = checked_limit(limit), index.blocks.sparkSession, index.doc
    wanted = search_terms(query, terms_, stop_words)
    schema = StructType([StructField("rnk", IntegerType()), StructField(doc, index.blocks.schema["postings"].dataType.elementType["doc"].dataType), StructField("score", LongType())])
    if not wanted or not k:
        return Hits(spark.createDataFrame([], schema), 0, 0)
    own = index.of(wanted)
    near = own.groupBy("segment").agg(F.sum("top").alias("most"), F.max("top").alias("least"))
    found = near.orderBy(F.col("most").desc(), "segment").limit(bounds + 1).collect()

    def scored(segments: list[int]) -> DataFrame:
        return _scores(own.where(f"segment IN ({', '.join(map(str, segments))})"), doc)

    # some document of each segment has its highest count, so k documents reach the k-th of these
    lows = sorted((r.least for r in found), reverse=True)
    reached = lows[k - 1] if len(lows) >= k else 0
    read = [r.segment for r in found[:first] if r.most >= reached]
    top = top_scores(scored(read), k, doc).collect() if read and k <= LISTED else []
    if len(top) == k:
        reached = max(reached, top[-1].score)
    rest = [r.segment for r in found[first:] if r.most >= reached]
    if len(read) + len(rest) > bounds:
        ahead = near.where(F.col("most") >= reached).select("segment")
        return Hits(rank(_scores(own.join(ahead, "segment", "left_semi"), doc), k, doc), len(found), len(found))
    if rest or k > LISTED:
        return Hits(rank(scored(read + rest), k, doc), len(found), len(read) + len(rest))
    return Hits(spark.createDataFrame([(i, *r) for i, r in enumerate(top, 1)], schema), len(found), len(read))
