"""Ranked term and phrase search, and substring search over terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import STOP_WORDS, ngram_bag, terms, terms_of
from weft.operators.index import build_index

DEFAULT_LIMIT = 20


def query_text(query=None, terms_: Sequence[str] | None = None) -> str:
    """A list of query words beats a list of terms, which beats a query string."""
    if isinstance(query, (list, tuple)):
        return " ".join(map(str, query))
    if terms_ is not None:
        return " ".join(map(str, terms_))
    return "" if query is None else str(query)


def search_terms(query=None, terms_: Sequence[str] | None = None, stop_words: Sequence[str] = STOP_WORDS) -> list[str]:
    """The whole normalised phrase, then its terms, without repeats. Phrases of over three terms match nothing themselves."""
    own = terms_of(query_text(query, terms_), stop_words)
    return list(dict.fromkeys([" ".join(own), *own])) if own else []


def checked_limit(limit) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int):
        return DEFAULT_LIMIT
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def top_scores(postings: DataFrame, k: int, doc: str = "doc_id", collation: str | None = None) -> DataFrame:
    """(doc, score) of the k best documents, best first: counts summed by document, ties by document. A null document is skipped, a null count is 0."""
    by = F.collate(F.col(doc), collation) if collation else F.col(doc)
    scored = postings.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("score"))
    return scored.orderBy(F.col("score").desc(), by).limit(k)


def rank(postings: DataFrame, limit, doc: str = "doc_id", collation: str | None = None) -> DataFrame:
    """(rnk, doc, score): top_scores() with places."""
    by = F.collate(F.col(doc), collation) if collation else F.col(doc)
    top = top_scores(postings, checked_limit(limit), doc, collation)
    # at most k rows are numbered
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), by)).alias("rnk"), doc, "score")


def search(index: DataFrame, query=None, terms_: Sequence[str] | None = None, limit: int = DEFAULT_LIMIT, doc: str = "doc_id", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Ranked search over an index; a query without terms reads nothing."""
    wanted = search_terms(query, terms_, stop_words)
    rows = index.where(F.col("term").isin(wanted)) if wanted else index.sparkSession.createDataFrame([], index.schema)
    return rank(rows, limit, doc)


def search_documents(docs: DataFrame, query, limit: int = DEFAULT_LIMIT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The same over documents without an index: only the query's terms are counted."""
    wanted = search_terms(query)
    rows = docs if wanted else docs.limit(0)
    return rank(build_index(rows, doc, text, only=wanted), limit, doc)


def search_many(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", text: str = "text", doc: str = "doc_id", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, rnk, doc, score): the k best documents of every query."""
    own = terms(F.col(text), stop_words)
    asked = queries.select(F.col(query_id), F.explode(F.array_distinct(F.concat(F.array(F.array_join(own, " ")), own))).alias("term"))
    scored = asked.join(index, "term").groupBy(query_id, doc).agg(F.sum("cnt").alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(doc))
    return scored.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


#: Bytes of a workload's distinct terms up to which they are broadcast.
PUSHED = 32 << 20


def search_many_documents(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", text: str = "text", doc: str = "doc_id", stop_words: Sequence[str] = STOP_WORDS, pushed: int = PUSHED) -> DataFrame:
    """search_many() without an index. The distinct asked terms are broadcast if they take no more than `pushed` bytes: then only n-grams that
    some query asks for are shuffled. Beyond that the index is built and joined."""
    own = terms(F.col(text), stop_words)
    asked = queries.select(F.explode(F.concat(F.array(F.array_join(own, " ")), own)).alias("term")).where("term <> ''").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    if size > pushed:
        return search_many(build_index(docs, doc, stop_words=stop_words), queries, k, query_id, text, doc, stop_words)
    found = docs.select(doc, F.explode(ngram_bag(own)).alias("term")).join(F.broadcast(asked), "term", "left_semi")
    return search_many(found.groupBy("term", doc).agg(F.count(F.lit(1)).alias("cnt")), queries, k, query_id, text, doc, stop_words)


def substring_search(index: DataFrame, query: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Rows whose term contains the processed query, letters inside words included."""
    return index.where(F.col("term").contains(" ".join(terms_of(query, stop_words))))
