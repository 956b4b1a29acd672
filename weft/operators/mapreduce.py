"""Generic MapReduce over Python functions, and the canonical jobs as DataFrame plans.

The generic form is for arbitrary functions. A job that can be said in columns should
be: the jobs below keep partial aggregation and never leave the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def emitted(mapper: Callable, key, value) -> Iterator[tuple[str, Any]]:
    """The pairs that a mapper's output stands for, see map_reduce()."""
    found = mapper(key, value) or []
    for item in [found] if isinstance(found, dict) else found:
        for k, v in list(item.items())[:1]:
            for one in v if isinstance(v, list) else [v]:
                for x in one if isinstance(one, list) else [one]:
                    yield str(k), x


def map_reduce(store: DataFrame, mapper: Callable, reducer: Callable, keys: DataFrame | None = None, combiner: Callable | None = None) -> DataFrame:
    """(k string, out string): one reducer output for each key, as JSON ("null" for None).

    store: (key, value). Keys without a row are skipped. mapper(key, value) gives None, a
    dict or dicts; of each the first item counts. A list value emits each of its members,
    and members that are lists are taken apart once more. reducer(k, values) is called
    once a key, in no order of values. No output of any mapper gives no rows. All values
    of a key meet in one task, as the reducer's signature demands, and only those of one
    key at a time are held; a combiner (k, values) -> values folds them before the shuffle,
    so that a hot key sends few. Aggregate in columns instead where that can say it.
    """
    rows = store.join(keys.select("key").distinct(), "key", "left_semi") if keys is not None else store

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [p for key, value in zip(pdf["key"], pdf["value"], strict=True) for p in emitted(mapper, key, value)]
            if combiner is not None:
                by: dict[str, list] = {}
                for k, v in out:
                    by.setdefault(k, []).append(v)
                out = [(k, x) for k, vs in by.items() for x in combiner(k, vs)]
            yield pd.DataFrame([(k, json.dumps(v)) for k, v in out], columns=["k", "v"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = (p for pdf in batches for p in zip(pdf["k"], pdf["v"], strict=True))
        out = []
        for k, own in groupby(pairs, lambda p: p[0]):  # the rows come in the order of keys
            out.append((k, json.dumps(reducer(k, [json.loads(v) for _, v in own]))))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["k", "out"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["k", "out"])

    sent = rows.select("key", "value").mapInPandas(emit, "k string, v string")
    return sent.repartition("k").sortWithinPartitions("k").mapInPandas(fold, "k string, out string")


def mapper_table(mapper: Callable):
    """A mapper as a table function (key, value) -> (k, v as JSON), for lateral joins and, once registered, for SQL."""

    @F.udtf(returnType="k string, v string")
    class Emit:
        def eval(self, key, value):
            for k, v in emitted(mapper, key, value):
                yield k, json.dumps(v)

    return Emit


def reducer_table(reducer: Callable):
    """A reducer as a table function over a table (k, v as JSON) partitioned by k -> (k, out as JSON). All values of a key meet, as its signature demands."""

    @F.udtf(returnType="k string, out string")
    class Reduce:
        def __init__(self):
            self._k, self._values = None, []

        def eval(self, row: Row):
            self._k = row["k"]
            self._values.append(json.loads(row["v"]))

        def terminate(self):
            if self._values:
                yield self._k, json.dumps(reducer(self._k, self._values))

    return Reduce


def map_reduce_tables(store: DataFrame, mapper: Callable, reducer: Callable) -> DataFrame:
    """map_reduce() as two table functions: the mapper beside each row, the reducer over partitions by key."""
    sent = store.select("key", "value").lateralJoin(mapper_table(mapper)(F.col("key").outer(), F.col("value").outer())).select("k", "v")
    return reducer_table(reducer)(sent.asTable().partitionBy("k"))


def aggregate_by_key(rows: DataFrame, k: Column, v: Column, zero: Callable[[], Any], add: Callable, merge: Callable, finish: Callable = lambda s: s, held: int = 100_000) -> DataFrame:
    """(k string, out string): a mergeable aggregate in Python. finish(state) of each key, as JSON.

    add(state, value) folds a task's values where they lie, at most `held` keys at a time; only states, as JSON, are
    shuffled and merge(a, b) joins them, so a key with a third of all rows is folded by
    all tasks and sends one state each. zero() starts a state. Order of values is undefined.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, Any] = {}
        for pdf in batches:
            for key, value in zip(pdf["k"], pdf["v"], strict=True):
                states[key] = add(states[key] if key in states else zero(), value)
                if len(states) >= held:
                    yield pd.DataFrame([(x, json.dumps(s)) for x, s in states.items()], columns=["k", "s"])
                    states = {}
        yield pd.DataFrame([(x, json.dumps(s)) for x, s in states.items()], columns=["k", "s"])

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = (p for pdf in batches for p in zip(pdf["k"], pdf["s"], strict=True))
        out = []
        for key, own in groupby(pairs, lambda p: p[0]):
            state = None
            for _, s in own:
                state = json.loads(s) if state is None else merge(state, json.loads(s))
            out.append((key, json.dumps(finish(state))))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["k", "out"])
                out = []
        yield pd.DataFrame(out, columns=["k", "out"])

    sent = rows.select(k.cast("string").alias("k"), v.alias("v")).mapInPandas(partial, "k string, s string")
    return sent.repartition("k").sortWithinPartitions("k").mapInPandas(final, "k string, out string")


def iterate(store: DataFrame, mapper: Callable, reducer: Callable, rounds: int, combiner: Callable | None = None) -> DataFrame:
    """`rounds` runs of map_reduce, each over the (key, value) rows that the one before gave; a round's output, a dict, is a row for each item.

    Values are JSON texts between rounds; a round is cut off by checkpoint().
    """
    out = map_reduce(store, mapper, reducer, combiner=combiner)
    for _ in range(rounds - 1):
        pairs = out.select(F.explode(F.from_json("out", "map<string,string>")).alias("key", "value"))
        out = map_reduce(pairs.checkpoint(), mapper, reducer, combiner=combiner)
    return out


class Registry:
    """Named functions: put, get (an absent name is an error) and remove; a job may name its mapper and reducer."""

    def __init__(self):
        self._held: dict[str, Callable] = {}

    def put(self, name: str, f: Callable) -> str:
        if not callable(f):
            raise TypeError(f"{name} is not a function")
        self._held[name] = f
        return name

    def get(self, name: str) -> Callable:
        if name not in self._held:
            raise KeyError(f"function {name} not found")
        return self._held[name]

    def rem(self, name: str) -> Callable:
        f = self.get(name)
        del self._held[name]
        return f

    def run(self, store: DataFrame, mapper: str, reducer: str, keys: DataFrame | None = None) -> DataFrame:
        return map_reduce(store, self.get(mapper), self.get(reducer), keys)


def max_by_key(rows: DataFrame, k: Column, v: Column) -> DataFrame:
    return rows.groupBy(k.alias("k")).agg(F.max(v).alias("v"))


def max_temperature(lines: DataFrame) -> DataFrame:
    """(k, v) of lines `station year datetime temperature quality`: the highest temperature of each year."""
    part = F.split("value", " +")
    return max_by_key(lines, F.get(part, F.lit(1)), F.expr("try_cast(get(split(value, ' +'), 3) AS int)"))


def average_word_length(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, avg_len): to two places, 0 without words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    total = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return docs.select(doc, F.when(F.size(words) > 0, F.floor(total / F.size(words) * 100 + 0.5) / 100).otherwise(F.lit(0.0)).alias("avg_len"))


def char_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ch, cnt) without white space, case kept."""
    chars = F.split(F.regexp_replace(text, r"\s+", ""), "")
    return docs.select(F.explode(chars).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt): case and punctuation kept."""
    return docs.select(F.explode(F.split(text, r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def tf_idf(docs: DataFrame, doc: str = "doc_id", text: str = "text", n_docs: int | None = None) -> DataFrame:
    """(word, doc, tfidf): count / length * log10(documents / documents with the word), to two places, halves up. n_docs: as given, else counted."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    # texts are shuffled by document, so that their words are counted where they are cut
    split = docs.select(doc, text).repartition(doc).select(doc, words.alias("words"))
    tf = split.select(doc, F.size("words").alias("len"), F.explode("words").alias("word")).groupBy(doc, "len", "word").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    if n_docs is None:
        n_docs = docs.count()
    score = F.col("c") / F.col("len") * F.log10(F.lit(n_docs) / F.col("df"))
    return tf.join(df, "word").select("word", doc, (F.floor(score * 100 + 0.5) / 100).alias("tfidf"))


def grep(rows: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return rows.where(F.col(text).rlike(pattern)).select(key)


def present_keys(asked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The keys that the store has, each once; others are skipped."""
    return asked.select(key).distinct().join(store, key, "left_semi")


def sum_by_key(rows: DataFrame, k: Column, v: Column) -> DataFrame:
    return rows.groupBy(k.alias("k")).agg(F.sum(v).alias("v"))


def gather(rows: DataFrame, k: Column, v: Column, order: Column) -> DataFrame:
    """(k, vs): the values of each key as a list, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v"))))
    return rows.groupBy(k.alias("k")).agg(F.transform(pairs, lambda p: p["v"]).alias("vs"))


def flattened(rows: DataFrame, k: Column, v: Column) -> DataFrame:
    """(k, v): array values taken apart, as the shuffle does."""
    return rows.select(k.alias("k"), F.explode(v).alias("v"))
