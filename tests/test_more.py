"""Table functions, mergeable aggregates, fetch errors, the page source, timers, variants, dictionaries."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.fetchers import get
from weft.functions import values
from weft.operators import index, mapreduce
from weft.sources import lists, pages
from weft.streaming import index_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- MapReduce


def test_table_functions_give_what_the_generic_job_gives(spark):
    store = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", None), (None, "z")], "key string, value string")
    mapper = lambda k, v: [{w: [1, [2]]} for w in (v or "").split()] or None
    reducer = lambda k, vs: {k: sum(vs)}
    want = rows(mapreduce.map_reduce(store, mapper, reducer))
    assert want and rows(mapreduce.map_reduce_tables(store, mapper, reducer)) == want
    assert rows(mapreduce.map_reduce_tables(store, lambda k, v: None, reducer)) == []
    assert rows(mapreduce.map_reduce_tables(store.limit(0), mapper, reducer)) == []


def test_a_hot_key_is_folded_in_every_task(spark):
    made = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(3000)] + [(None, 5)]
    df = spark.createDataFrame(made, "k string, v bigint").repartition(6)
    for held in (100_000, 2):
        got = mapreduce.aggregate_by_key(df, F.col("k"), F.col("v"), lambda: [0, 0], lambda s, v: [s[0] + 1, s[1] + int(v)], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[1] / s[0], held)
        want = {}
        for k, v in made:
            want.setdefault(k, []).append(v)
        assert {r.k: json.loads(r.out) for r in got.collect()} == {k: sum(v) / len(v) for k, v in want.items()}
    assert mapreduce.aggregate_by_key(df.limit(0), F.col("k"), F.col("v"), int, lambda s, v: s, lambda a, b: a).count() == 0


# ---- fetching

URLS = ["http://a.com/1", "http://a.com/2", "http://b.com/down", "http://c.com/gone", "http://A.com/3"]


def test_failures_are_rows_or_errors(spark):
    urls = spark.createDataFrame([(u,) for u in [*URLS, URLS[0], None]], "url string")
    got = {r.url: (r.html, r.error, r.tries) for r in pages.fetch_rows(urls, get, tries=2).collect()}
    assert set(got) == set(URLS) and got[URLS[0]] == ("<p>http://a.com/1</p>", None, 1)
    assert got[URLS[2]] == (None, "OSError: no route", 2) and got[URLS[3]] == (None, "no page", 2)
    assert {r.url: r.html for r in pages.fetch(urls, get).collect()}[URLS[2]] == ""
    with pytest.raises(Exception, match="could not fetch http://b.com/down"):
        pages.fetch_or_fail(urls.where("url LIKE '%down'"), get).collect()
    assert rows(pages.fetch_or_fail(urls.where("url LIKE 'http://a%'"), get)) == [(u, f"<p>{u}</p>") for u in URLS[:2]]


def test_page_source(spark, tmp_path):
    spark.dataSource.register(pages.PageSource)
    read = spark.read.format("weft_pages").option("urls", "\n".join([*URLS, "", URLS[0]])).option("fetcher", "tests.fetchers:get").option("tries", "2")
    df = read.load()
    assert df.rdd.getNumPartitions() == 3  # by host
    assert {r.url: (r.html, r.error) for r in df.collect()} == {u: (f"<p>{u}</p>", None) if i in (0, 1, 4) else (None, "OSError: no route" if i == 2 else "no page") for i, u in enumerate(URLS)}
    with pytest.raises(Exception, match="could not fetch http"):
        read.option("failures", "raise").load().collect()
    with pytest.raises(Exception, match="failures must be rows or raise"):
        read.option("failures", "never").load().collect()
    stream = spark.readStream.format("weft_pages").option("urls", "\n".join(URLS)).option("fetcher", "tests.fetchers:get").option("batch", "2").load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(URLS)


# ---- timers


def test_urls_are_due_again(spark, tmp_path):
    batches = [[("a", 0), ("b", 10), ("a", 20)], [("c", 65)], [("a", 130)], [("d", 400)], [("e", 1000)]]
    for i, own in enumerate(batches):
        df = spark.createDataFrame(own, "url string, s bigint").select("url", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = index_stream.document_stream(spark, str(tmp_path / "in"), "url string, ts timestamp")
    q = index_stream.due_visits(stream, "60 seconds", visits=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.url, []).append((r.visit, int(r.due.timestamp()) - 1_700_000_000))
    assert sorted(got["a"]) == [(1, 0), (2, 60), (3, 120)] and sorted(got["b"]) == [(1, 10), (2, 70), (3, 130)] and sorted(got["c"]) == [(1, 65), (2, 125), (3, 185)]
    assert sorted(got["d"]) == [(1, 400), (2, 460), (3, 520)] and got["e"] == [(1, 1000)]
    with pytest.raises(ValueError):
        index_stream.due_visits(stream, "0 seconds")


# ---- values without a schema


def test_values_go_round(spark):
    made = [(1, True, 2.5, 'q"é\n', datetime(2024, 1, 2, 3, 4, 5, 678000), [1, 2], {"a": "x"}), (2, None, None, None, None, None, None), (3, False, float("nan"), "", datetime(1969, 12, 31), [], {}), (4, False, float("-inf"), "null", datetime(2000, 1, 1), None, {"$x": "y"})]
    df = spark.createDataFrame(made, "id int, b boolean, n double, s string, t timestamp, a array<int>, m map<string,string>")
    kinds = {"b": "boolean", "n": "number", "s": "string", "t": "date", "a": "value", "m": "value"}
    texts = df.select("id", *[values.encoded(F.col(c), k).alias(c) for c, k in kinds.items()])
    held = texts.select("id", *[values.decoded(F.col(c)).alias(c) for c in kinds])
    got = {r.id: r for r in held.select("id", values.member(F.col("b"), "$", "boolean").alias("b"), values.as_number(F.col("n")).alias("n"), values.as_string(F.col("s")).alias("s"), values.as_date(F.col("t")).alias("t"), values.member(F.col("a"), "$", "array<int>").alias("a"), values.member(F.col("m"), "$.a", "string").alias("m")).collect()}
    for i, b, n, s, t, a, m in made:
        r = got[i]
        assert (r.b, r.s, r.t, r.a, r.m) == (b, s, t, a, (m or {}).get("a")) and (r.n == n or n != n and r.n != r.n)
    kinds_of = {r.id: tuple(r)[1:] for r in held.select("id", *[values.kind_of(F.col(c)).alias(c) for c in kinds]).collect()}
    assert kinds_of[1] == ("boolean", "number", "string", "date", "array", "object") and set(kinds_of[2]) == {"null"} and kinds_of[3][1] == "number"
    bad = spark.createDataFrame([("{",), (None,), ('{"$error":{"name":"E","message":"m"}}',)], "v string").select(values.decoded(F.col("v")).alias("v"))
    assert [r.k for r in bad.select(values.kind_of(F.col("v")).alias("k")).collect()] == [None, None, "error"]
    with pytest.raises(ValueError):
        values.encoded(F.col("b"), "function")


# ---- dictionaries


def test_a_dictionary_of_any_size(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cats running of cats"), (2, None), (3, "the of"), (1, "cats"), (None, "x cats")], "doc_id bigint, text string")
    words = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)), "the", "of", "", " the "]
    (tmp_path / "words.txt").write_text("\n".join(words))
    stops = lists.word_table(spark, str(tmp_path / "words.txt"))
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, rows(index.build_index(docs.where("doc_id IS NOT NULL"), stop_words=["the", "of"]))))
    assert sorted(map(key, rows(index.build_index(docs.where("doc_id IS NOT NULL"), stop_words=stops)))) == want
    assert {r.term: r.cnt for r in index.build_index(docs, stop_words=stops, only=["cat", "cat runn"]).where("doc_id = 1").collect()} == {"cat": 3, "cat runn": 1}
    assert index.build_index(docs.limit(0), stop_words=stops).count() == 0


# ---- traversal


def test_pages_do_not_move_at_a_level(spark):
    from weft.operators import crawl
    from weft.plans import inspect

    pages_ = spark.range(1000).select(F.col("id").cast("string").alias("url"), F.array(F.lit("x")).alias("links"), F.lit(True).alias("indexed")).repartition("url").checkpoint()
    frontier = spark.createDataFrame([("5", 0, 0)], "url string, depth int, ord bigint").checkpoint()
    small, large = (crawl.pages_of(pages_, frontier, n) for n in (100, crawl.FRONTIER + 1))
    assert inspect.shuffles(small) == 0 and "BuildRight" in inspect.physical(small) and "SortMergeJoin" in inspect.physical(large)
    assert rows(small) == rows(large) == [("5", ["x"], True)]
