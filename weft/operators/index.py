"""Inverted index: build, merge, write, read. The canonical form is the long table (term, doc, cnt)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.functions.hashing import HASHERS, content_id, content_id_of
from weft.functions.text import STOP_WORDS, ngram_bag, stem, terms, tokens


def without_words(docs: DataFrame, words: DataFrame, doc: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """(doc, terms): the stemmed tokens of each row in order, those in the table `words` left out.

    For dictionaries that are too large to be part of a plan: Spark broadcasts the table if its size
    allows that, else joins by word, where a frequent word's rows are split by their place. A row without tokens has no terms.
    """
    rows = docs.select(doc, text).withColumn("_row", F.monotonically_increasing_id())
    found = rows.select("_row", doc, F.posexplode(tokens(F.col(text), ())).alias("_pos", "_word"))
    stops = words.select(F.col(word).alias("_word")).where("_word IS NOT NULL").distinct()
    left = found.join(stops, "_word", "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_word")))
    own = left.groupBy("_row", doc).agg(F.transform(listed, lambda t: stem(t["_word"])).alias("terms"))
    return own.select(doc, "terms")


#: Documents of a task that sorts its n-grams, and of a word beyond which its postings are ranked in slices.
TASK_DOCS, FREQUENT = 5_000, 1_000_000
#: The first word of a term, in an index whose rows of one first word lie in one partition.
HEAD = "_head"


def tasks_of(docs: DataFrame) -> int:
    """Tasks over docs, TASK_DOCS rows each, or one a core."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCS))


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words: Sequence[str] | DataFrame = STOP_WORDS, only: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """(term, doc, cnt) of all n-grams; with `only`, of those terms: no other sizes are formed and no other terms shuffled.

    Texts are shuffled by document before they are taken apart, so their n-grams, many
    times as large, need no shuffle: they are counted where they are formed. Rows that
    share an id are one document. stop_words may be a table (word), of any size.
    `tasks` fixes the number of tasks, for what sorts or writes the rows where they are.
    """
    if isinstance(stop_words, DataFrame):
        bag = ngram_bag(F.col("terms"))
        if only is not None:
            bag = F.filter(bag, lambda t: t.isin(*only))
        found = without_words(docs, stop_words, doc, text).repartition(doc).select(doc, F.explode(bag).alias("term"))
        return found.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("cnt")).select("term", doc, "cnt")
    if only is None:
        own = docs.select(doc, text)
        own = own.repartition(tasks, doc) if tasks else own.repartition(doc)
        found = own.select(doc, F.explode(ngram_bag(terms(F.col(text), stop_words))).alias("term"))
        return found.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("cnt")).select("term", doc, "cnt")
    sizes = sorted({n for n in (len(t.split(" ")) for t in only) if n <= 3})
    bag = ngram_bag(terms(F.col(text), stop_words), sizes) if sizes else F.array().cast("array<string>")
    found = docs.select(doc, F.explode(F.filter(bag, lambda t: t.isin(*only))).alias("term"))
    return found.groupBy("term", doc).agg(F.count(F.lit(1)).alias("cnt"))


def index_by_head(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(HEAD, term, doc, cnt): the rows of build_index(), dealt by the first word of the term.

    A word moves with the two that follow it, and its three n-grams are formed and counted where it
    arrives: a row a word is shuffled, not three. What groups by HEAD and term moves nothing more.
    """

    def runs(own: Column) -> Column:
        tail = lambda k: F.slice(own, F.lit(k + 1), F.greatest(F.size(own) - k, F.lit(0)))
        follow = F.zip_with(tail(1), tail(2), lambda x, y: F.concat_ws(" ", x, y))
        return F.zip_with(own, follow, lambda w, t: F.struct(w.alias("head"), F.coalesce(t, F.lit("")).alias("tail")))

    # bound once, as in ngram_bag()
    found = docs.select(doc, F.inline(F.transform(F.array(terms(F.col(text), stop_words)), runs)[0]))
    head, tail = F.col(HEAD), F.col("tail")
    dealt = found.withColumnRenamed("head", HEAD).repartition(max(tasks_of(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), HEAD)
    two = F.when(tail != "", F.concat(head, F.lit(" "), F.substring_index(tail, " ", 1)))
    three = F.when(F.contains(tail, F.lit(" ")), F.concat(head, F.lit(" "), tail))
    each = dealt.select(HEAD, doc, F.explode(F.array(head, two, three)).alias("term")).where("term IS NOT NULL")
    return each.groupBy(HEAD, "term", doc).agg(F.count(F.lit(1)).alias("cnt")).select(HEAD, "term", doc, "cnt")


def over_terms(docs: DataFrame, made: Callable[[DataFrame], DataFrame], doc: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """made(index) for a `made` that works term by term, over the index dealt by first words.

    Terms whose first word stands in over `frequent` documents come as a plain index, so that no task
    holds all of a word that most documents have; such words are looked for only in more rows than that.
    """
    heavy: list = []
    if docs.count() > frequent:
        words = docs.select(doc, F.explode(F.array_distinct(terms(F.col(text), stop_words))).alias("w"))
        heavy = [r.w for r in words.groupBy("w").count().where(F.col("count") > frequent).collect()]
    own = index_by_head(docs, doc, text, stop_words)
    if not heavy:
        return made(own).drop(HEAD)
    rest = build_index(docs, doc, text, stop_words).where(F.substring_index("term", " ", 1).isin(heavy))
    return made(own.where(~F.col(HEAD).isin(heavy))).drop(HEAD).unionByName(made(rest))


def key_of(index: DataFrame) -> list[str]:
    """The columns that name a term and keep its rows where they are."""
    return [HEAD, "term"] if HEAD in index.columns else ["term"]


def merge_index(*parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One index of several: counts are summed by term and document."""
    out = parts[0].select("term", doc, "cnt")
    for p in parts[1:]:
        out = out.unionByName(p.select("term", doc, "cnt"))
    return out.groupBy("term", doc).agg(F.sum("cnt").alias("cnt"))


#: Slices of the documents in which a term's postings are ranked, and the documents that are looked at to cut them.
SLICES, SEEN = 64, 4096


def _slice_of(doc: Column, bounds: list) -> Column:
    """How many of the ascending bounds are not above doc: a search by halves, in one expression. A null stands first."""
    if not bounds:
        return F.lit(0)

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc < F.lit(bounds[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return F.when(doc.isNull(), F.lit(0)).otherwise(place(0, len(bounds)))


def ranked_postings(index: DataFrame, doc: str = "doc_id", order: Sequence[str] | None = None, slices: int = SLICES) -> DataFrame:
    """index with rnk: the place in the term's posting list, by count downwards, then by `order` (the document, if not given).

    In two levels, so that no task ranks a whole list: rows are ranked among those with
    the same term, count and slice of the first order column, and the sizes of these groups give what stands
    before each. Rows move once; only group sizes move again. Slices are cut at
    quantiles of at most SEEN rows; how even they are bears on speed alone.
    An index dealt by first words is ranked where it is; over_terms() keeps frequent ones out of it.
    """
    order = list(order or [doc])
    if HEAD in index.columns:
        place = F.row_number().over(Window.partitionBy(HEAD, "term").orderBy(F.col("cnt").desc(), *order))
        return index.select(*index.columns, place.alias("rnk"))
    kind = index.schema[order[0]].dataType.simpleString()
    bounds: list = []
    if slices > 1 and kind in ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp"):
        seen = sorted(r[0] for r in index.select(order[0]).where(F.col(order[0]).isNotNull()).limit(SEEN).collect())
        bounds = sorted({seen[len(seen) * i // slices] for i in range(1, slices)}) if seen else []
    dealt = index.withColumn("_s", _slice_of(F.col(order[0]), bounds)).repartition("term", "cnt", "_s")
    group = ["term", "cnt", "_s"]
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    sizes = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("term").orderBy(F.col("cnt").desc(), "_s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return ranked.join(ahead, group).select(*index.columns, (F.col("_r") + F.col("_b")).cast("int").alias("rnk"))


def posting_lists(index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(term, postings): each an array of (doc, cnt) in posting order. For edges only; queries use the long table."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), F.col(doc).alias("doc"))))
    return index.groupBy("term").agg(F.transform(pairs, lambda p: F.struct(p["doc"].alias(doc), (-p["neg"]).alias("cnt"))).alias("postings"))


def shard_of(term: Column, nids: Sequence[str], hasher: str = "naive") -> Column:
    """The node that owns a term."""
    return HASHERS[hasher](content_id(term), list(nids))


def shard_number(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def shard_of_literal(term: str, shards: int) -> int:
    """shard_number() on the driver: no job for a search's few terms."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % shards


def write_index(index: DataFrame, path: str, shards: int = 64, config: dict | None = None, files: int | None = 1) -> None:
    """A directory for each shard, terms in order inside, so that a search opens few row groups; a manifest beside it.

    A shard is written by `files` tasks, each with its share of the shard's terms. They
    are dealt by a hash, as ranges would have to be found by computing the index twice.
    With files=None no row moves: each task adds a file of its own terms to every shard.
    """
    spark = index.sparkSession
    rows = index.withColumn("shard", shard_number(F.col("term"), shards))
    if files is not None:
        rows = rows.repartition(F.col("shard"), F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(files)))
    rows.sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(f"{path}/postings")
    manifest = {"shards": shards, "config": content_id_of(config or {}), "schema": rows.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def read_index(spark: SparkSession, path: str, terms_: Sequence[str] | None = None) -> DataFrame:
    """The index, or its rows for some terms: only their shards are listed and the terms are pushed to the scan."""
    held = read_manifest(spark, path)
    rows = spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{path}/postings")
    if terms_ is None:
        return rows.drop("shard")
    return rows.where(F.col("shard").isin(sorted({shard_of_literal(t, held["shards"]) for t in terms_})) & F.col("term").isin(list(terms_))).drop("shard")


def corpus_fingerprint(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> str:
    """Of all (id, text) pairs, whatever their order and partitions: their number and two sums of independent 64-bit hashes. One pass, no shuffle of rows."""
    both = [F.xxhash64(F.lit(seed), doc, F.length(text), text).cast("decimal(38,0)") for seed in (1, 2)]
    n, a, b = docs.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0)) for h in both]).first()
    return f"{n}-{int(a)}-{int(b)}"


def cached_index(spark: SparkSession, path: str, config: dict, build, corpus: DataFrame | None = None, doc: str = "doc_id", text: str = "text", files: int | None = 1) -> DataFrame:
    """The index at path if it was built under the same configuration and, where the corpus is given, of the same documents; else build() written there."""
    if corpus is not None:
        config = {**config, "corpus_fingerprint": corpus_fingerprint(corpus, doc, text)}
    try:
        fits = read_manifest(spark, path)["config"] == content_id_of(config)
    except Exception as e:  # noqa: BLE001  an absent path is reported in several ways
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fits = False
    if not fits:
        write_index(build(), path, config=config, files=files)
    return read_index(spark, path)


def top_terms(index: DataFrame, k: int = 5, doc: str = "doc_id") -> DataFrame:
    """The k most frequent terms of each document, ties by term."""
    order = Window.partitionBy(doc).orderBy(F.col("cnt").desc(), F.col("term"))
    return index.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def sample_docs(docs: DataFrame, samples: int = 3, doc: str = "doc_id", text: str = "text", k: int = 5, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(doc, text_chars, unique_terms, top_terms): the first documents by id, and the k most frequent n-grams of each as (term, cnt), ties by term. Only their texts are taken apart."""
    some = docs.select(doc, text).orderBy(doc).limit(samples)
    counts = some.select(doc, F.explode(ngram_bag(terms(F.col(text), stop_words))).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("cnt"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "term"))), 1, k)
    sums = counts.groupBy(doc).agg(F.count(F.lit(1)).alias("unique_terms"), F.transform(listed, lambda t: F.struct(t["term"].alias("term"), (-t["neg"]).alias("cnt"))).alias("top_terms"))
    none = F.array().cast("array<struct<term:string,cnt:bigint>>")
    return some.select(doc, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("text_chars")).join(sums, doc, "left").select(doc, "text_chars", F.coalesce("unique_terms", F.lit(0)).cast("bigint").alias("unique_terms"), F.coalesce("top_terms", none).alias("top_terms"))


def index_stats(docs: DataFrame, index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: docs, docs_with_terms, terms."""
    return docs.agg(F.count(F.lit(1)).alias("docs")).crossJoin(index.agg(F.count_distinct(doc).alias("docs_with_terms"), F.count_distinct("term").alias("terms")))
