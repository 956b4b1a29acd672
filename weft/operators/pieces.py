"""Substring search over terms by an index of three-letter pieces.

The pieces of distinct words, their ends marked, lead to the words that may hold a query;
a table of words and the terms they stand in leads on to the terms. Terms are many
times as many as words, so terms' own pieces are never formed. `contains` confirms.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import STOP_WORDS, terms_of
from weft.operators.index import HEAD, read_index, read_manifest, shard_number, shard_of_literal, write_index

#: Marks before and behind a word; words are letters.
FRONT, BACK = "^", "$"


def pieces_of(marked: str) -> list[str]:
    """Distinct runs of three letters, in order."""
    return list(dict.fromkeys(marked[i : i + 3] for i in range(len(marked) - 2)))


def _pieces(word: Column) -> Column:
    marked = F.concat(F.lit(FRONT), word, F.lit(BACK))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(marked, i, F.lit(3))))


def write_substring_index(index: DataFrame, path: str, shards: int = 16) -> None:
    """The long index (term, doc, cnt) written with its words and pieces. Each table is dealt by its key's hash and in order inside; a word's row in `terms` is shared out over as many files as terms are.

    Of an index dealt by first words all rows of a term are in one task, which adds its postings and its
    terms' words to every shard, so neither is shuffled.
    """
    spark, dealt = index.sparkSession, HEAD in index.columns
    write_index(index.drop(HEAD), f"{path}/index", shards, files=None if dealt else 1)
    terms = index.groupBy(HEAD, "term").agg(F.lit(1)) if dealt else read_index(spark, f"{path}/index").select("term").distinct()
    pairs = terms.select(F.explode(F.array_distinct(F.split("term", " "))).alias("word"), "term").withColumn("shard", shard_number(F.col("word"), shards))
    if not dealt:
        pairs = pairs.repartition("shard", F.pmod(F.xxhash64("term"), F.lit(4)))
    pairs.sortWithinPartitions("shard", "word", "term").write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(f"{path}/terms")
    words = spark.read.parquet(f"{path}/terms").select("word").distinct()
    rows = words.select(F.explode(_pieces(F.col("word"))).alias("piece"), "word")
    rows.withColumn("shard", shard_number(F.col("piece"), shards)).repartition("shard").sortWithinPartitions("shard", "piece").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/pieces")
    spark.createDataFrame([(json.dumps({"shards": shards}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _where(table: DataFrame, column: str, values: Sequence[str], shards: int) -> DataFrame:
    return table.where(F.col("shard").isin(sorted({shard_of_literal(v, shards) for v in values})) & F.col(column).isin(list(values)))


def candidate_words(spark: SparkSession, path: str, part: str, front: bool, back: bool) -> DataFrame:
    """(word) of the words that hold `part`, at their front or back if so asked: those with all its pieces, confirmed.

    A part too short for a piece of its own is looked for within the pieces: any two letters of a marked word stand in one.
    """
    shards = read_manifest(spark, path)["shards"]
    marked = (FRONT if front else "") + part + (BACK if back else "")
    own, rows = pieces_of(marked), spark.read.parquet(f"{path}/pieces")
    if own:
        met = _where(rows, "piece", own, shards).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own)).select("word")
    else:
        met = rows.where(F.col("piece").contains(marked)).select("word").distinct()
    return met.where(F.concat(F.lit(FRONT), "word", F.lit(BACK)).contains(marked))


def candidate_terms(spark: SparkSession, path: str, query: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term) of the terms that contain the processed query, letters inside words included."""
    shards, text = read_manifest(spark, path)["shards"], " ".join(terms_of(query, stop_words))
    pairs = spark.read.parquet(f"{path}/terms")
    parts = text.split(" ")
    if not text:
        return pairs.select("term").distinct()
    if len(parts) > 2:  # the middle is a whole word
        found = _where(pairs, "word", [parts[1]], shards)
    else:
        at = max(range(len(parts)), key=lambda i: len(parts[i]))
        words = candidate_words(spark, path, parts[at], front=at > 0, back=at < len(parts) - 1)
        found = pairs.withColumn("shard", F.col("shard")).join(words.withColumn("shard", shard_number(F.col("word"), shards)), ["shard", "word"], "left_semi")
    return found.where(F.col("term").contains(text)).select("term").distinct()


def substring_search(spark: SparkSession, path: str, query: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The index rows whose term contains the processed query: postings are read in the shards of candidate terms alone, where these come out few."""
    shards = read_manifest(spark, f"{path}/index")["shards"]
    found = candidate_terms(spark, path, query, stop_words).withColumn("shard", shard_number(F.col("term"), shards))
    return spark.read.parquet(f"{path}/index/postings").join(found, ["shard", "term"], "left_semi").drop("shard")
