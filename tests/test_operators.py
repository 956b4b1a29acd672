import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weft.operators import crawl, kv, mapreduce, stats
from weft.sources import codec, lists, metrics, pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- MapReduce


def store(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def test_generic_jobs(spark):
    s = store(spark, [("a", "x y x"), ("b", "y"), ("c", None)])
    count = mapreduce.map_reduce(s, lambda k, v: [{w: 1} for w in (v or "").split()] or None, lambda k, vs: sum(vs))
    assert rows(count) == [("x", "2"), ("y", "2")]
    assert rows(mapreduce.map_reduce(s, lambda k, v: None, lambda k, vs: 1)) == []
    asked = spark.createDataFrame([("b",), ("zz",), ("b",)], "key string")
    assert rows(mapreduce.map_reduce(s, lambda k, v: {k: v}, lambda k, vs: vs, asked)) == [("b", '["y"]')]
    assert rows(mapreduce.map_reduce(s, lambda k, v: {"s": 1, "ignored": 2}, lambda k, vs: None)) == [("s", "null")]


def test_values_are_flattened(spark):
    s = store(spark, [("a", "")])
    out = mapreduce.map_reduce(s, lambda k, v: [{"k": [1, [2, 3]]}, {"k": 4}], lambda k, vs: sorted(vs))
    assert rows(out) == [("k", "[1, 2, 3, 4]")]


def test_max_temperature(spark):
    lines = "006 1950 0515070049999 0000 1\n004 1950 0515120049999 +0022 1\n004 1950 0515180049999 -0011 1\n065 1949 0324120040500 +0111 1\n065 1949 0324180040500 +0078 1".split("\n")
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(mapreduce.max_temperature(df)) == [("1949", 111), ("1950", 22)]


def test_tf_idf(spark):
    df = spark.createDataFrame([("1", "machine learning is amazing"), ("2", "deep learning powers amazing systems"), ("3", "machine learning and deep learning are related")], "doc_id string, text string")
    got = {(r.word, r.doc_id): r.tfidf for r in mapreduce.tf_idf(df).collect()}
    assert got[("is", "1")] == 0.12 and got[("deep", "2")] == 0.04 and got[("deep", "3")] == 0.03 and got[("learning", "2")] == 0.0 and got[("are", "3")] == 0.07
    assert len({w for w, _ in got}) == 10


def test_text_jobs(spark):
    df = spark.createDataFrame([(1, "ab b"), (2, ""), (3, None), (4, "one three five sevens 1 1 1")], "doc_id bigint, text string")
    assert rows(mapreduce.average_word_length(df)) == [(1, 1.5), (2, 0.0), (3, 0.0), (4, 3.0)]
    assert rows(mapreduce.char_frequency(df.where("doc_id = 1"))) == [("a", 1), ("b", 2)]
    assert ("1", 3) in rows(mapreduce.word_count(df))
    assert rows(mapreduce.grep(df, "^one")) == [(4,)]
    assert rows(mapreduce.gather(df, F.lit("k"), F.col("doc_id"), -F.col("doc_id"))) == [("k", [4, 3, 2, 1])]


# ---- keyed tables


def test_keyed_table(spark):
    log = spark.createDataFrame([("g", "a", "1", 1), ("g", "a", "2", 3), ("g", "b", "x", 2), ("h", "a", "9", 1)], "gid string, key string, value string, seq bigint")
    held = kv.last_writes(log)
    assert rows(held) == [("g", "a", "2", 3), ("g", "b", "x", 2), ("h", "a", "9", 1)]
    more = spark.createDataFrame([("g", "a", "3", 4)], "gid string, key string, value string, seq bigint")
    assert ("g", "a", "3", 4) in rows(kv.put(held, more))
    assert kv.get(held, "a", "h").first().value == "9" and rows(kv.get(held, None, "g")) == [("a",), ("b",)]
    with pytest.raises(KeyError):
        kv.get(held, "zz", "g")
    left, gone = kv.delete(held, spark.createDataFrame([("g", "a"), ("g", "no")], "gid string, key string"))
    assert rows(left) == [("g", "b", "x", 2), ("h", "a", "9", 1)] and rows(gone) == [("g", "a", "2", 3)]
    assert {(r.gid, r.key): list(r["values"]) for r in kv.append(log).collect()}[("g", "a")] == ["1", "2"]
    arrays = log.withColumn("value", F.array("value", "key"))
    assert {(r.gid, r.key): list(r["values"]) for r in kv.append(arrays, flatten=True).collect()}[("g", "a")] == ["1", "a", "2", "a"]


def test_null_key_is_content_address(spark):
    df = spark.createDataFrame([(None, "v"), ("k", "v")], "key string, value string")
    got = rows(kv.addressed(df))
    assert {len(r[0]) for r in got} == {1, 64} and all(r[2] == "local" for r in got)


def test_moved(spark):
    df = spark.range(200).select(F.col("id").alias("k0"))
    for hasher in ("naive", "rendezvous"):
        got = kv.moved(df, "k0", ["n1", "n2", "n3"] if hasher == "rendezvous" else ["a" * 64, "b" * 64], ["n1", "n2", "n3", "n4"] if hasher == "rendezvous" else ["a" * 64, "b" * 64, "c" * 64], hasher).collect()
        assert got and (hasher == "naive" or all(r.new_nid == "n4" for r in got))  # rendezvous moves keys to the new node only


# ---- traversal


def site(spark, links):
    return spark.createDataFrame(list(links.items()), "url string, links array<string>")


def test_traverse(spark):
    s = site(spark, {"a": ["a", "b", "c"], "b": ["c", "d"], "c": ["e"], "d": [], "e": ["f"]})
    got = {r.url: (r.depth, r.fetched) for r in crawl.traverse(s, ["a"], 2, None).collect()}
    assert got == {"a": (0, True), "b": (1, True), "c": (1, True), "d": (2, True), "e": (2, True)}
    assert {r.url for r in crawl.traverse(s, ["a"], 0).collect()} == {"a"}
    assert {r.url: r.fetched for r in crawl.traverse(s, ["zz"], 3).collect()} == {"zz": False}
    with pytest.raises(ValueError):
        crawl.traverse(s, [], 1)


def test_traverse_budget(spark):
    s = site(spark, {"a": ["a", "b", "c", "d"], "b": [], "c": [], "d": []})
    got = crawl.traverse(s, ["a"], 3, 2).where("fetched").collect()
    assert [r.url for r in sorted(got, key=lambda r: (r.depth, r.url))] == ["a", "b"]
    only = crawl.traverse(s, ["a"], 3, 2, indexable=F.col("url") != "a").where("indexed").collect()
    assert {r.url for r in only} == {"b", "c"}


def test_reverse_links(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "page_id bigint, href string")
    assert rows(crawl.reverse_links(df)) == [("x", 2), ("y", 1)]


def test_fetch(spark):
    def get(url):
        if url == "bad":
            raise OSError
        return f"<a href='/{url}'>"

    got = pages.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), get)
    assert rows(got) == [("bad", ""), ("ok", "<a href='/ok'>")]
    full = spark.createDataFrame([("http://h/a", "<a href='b'>"), ("http://h/z", "")], "url string, html string")
    assert rows(pages.linked(full)) == [("http://h/a", ["http://h/a", "http://h/b"])]


# ---- statistics, sources


def test_summary(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0)], "k string, v double")
    assert rows(stats.summary(df, "v", ["k"])) == [("a", 2, 3.0, 1.0, 2.0, 4.0), ("b", 1, 1.0, 0.0, 1.0, 1.0)]
    assert rows(stats.summary(df.limit(0), "v")) == [(0, 0.0, 0.0, 0.0, 0.0)]
    assert stats.node_counts(["1", 3, 3.0, "x", 0, math.inf, None]) == [1, 3]
    assert stats.bottleneck(spark.createDataFrame([(0.0,), (3.0,), (2.0,)], "throughput double")).first()[0] == 2.0


def test_diff_ratio(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "w string") for s in ("abca", "bcxyz"))
    assert stats.diff_ratio(a, b).first().ratio == 1.0
    assert stats.diff_ratio(a, a).first().ratio == 0.0


def test_node_status(spark):
    df = spark.createDataFrame([("n2", "s2", 5), ("n1", "s1", 7)], "nid string, sid string, heap_total bigint")
    assert stats.node_status(df).first().asDict() == {"heap_total": 12, "nids": ["n1", "n2"], "sids": ["s1", "s2"]}


def test_codec():
    values = [None, True, False, 0, -12, 2.5, math.inf, "", "é\"", [], [1, [None]], {}, {"a": {"b": [1]}}, datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)]
    for v in values:
        assert codec.decode(codec.encode(v)) == v
    assert math.isnan(codec.decode(codec.encode(math.nan)))
    assert str(codec.decode(codec.encode(ValueError("m")))) == "m"
    with pytest.raises(TypeError):
        codec.encode(object())
    with pytest.raises(TypeError):
        codec.decode(None)


def test_lists(spark, tmp_path):
    assert lists.parse_nodes("1.2.3.4:80, h:81") == [{"ip": "1.2.3.4", "port": 80}, {"ip": "h", "port": 81}]
    for bad in ("", "h", "h:x", ":1", "h:99999"):
        with pytest.raises(ValueError):
            lists.parse_nodes(bad)
    (tmp_path / "n.json").write_text('[{"ip": "h", "port": 1}]')
    assert lists.read_nodes(spark, str(tmp_path / "n.json")) == [{"ip": "h", "port": 1}]
    (tmp_path / "w.txt").write_text("\nthe\n of \nthe\n")
    assert lists.read_words(spark, str(tmp_path / "w.txt")) == ["the", "of"]
    with pytest.raises(ValueError):
        lists.read_words(spark, str(tmp_path / "w.txt"), 1)
    with pytest.raises(ValueError):
        lists.seeds(spark, [])


def test_metrics(spark, tmp_path):
    m = metrics.metrics(spark, [("search", 500.0, 4, "queries"), ("none", 0.0, 0, "x")])
    assert rows(m) == [("none", 0.0, 0.0, 0, "x"), ("search", 125.0, 8.0, 4, "queries")]
    path = str(tmp_path / "m")
    metrics.checkpoint_stage(m.where("component = 'none'"), path, "one")
    metrics.checkpoint_stage(m, path, "two")
    metrics.checkpoint_stage(m, path, "one")
    assert spark.read.parquet(path).count() == 4
    metrics.write_csv(m, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def _count(key, value):
    return [{w: 1} for w in (value or "").split()]


def _total(key, values):
    return {key: sum(values)}


def test_combiner_registry_and_rounds(spark):
    from weft.operators import mapreduce

    store = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "key bigint, value string")
    want = {"a": '{"a": 2}', "b": '{"b": 2}', "c": '{"c": 1}'}
    assert {r.k: r.out for r in mapreduce.map_reduce(store, _count, _total, combiner=lambda k, vs: [sum(vs)]).collect()} == want
    held = mapreduce.Registry()
    held.put("count", _count)
    held.put("total", _total)
    assert {r.k: r.out for r in held.run(store, "count", "total").collect()} == want
    assert held.rem("count") is _count
    with pytest.raises(KeyError):
        held.get("count")
    with pytest.raises(TypeError):
        held.put("x", 1)


def test_rounds(spark, tmp_path):
    """The second round counts how many words have each count."""
    from weft.operators import mapreduce

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    store = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d")], "key string, value string")
    mapper = lambda k, v: [{v: 1}] if v.isdigit() else [{w: 1} for w in v.split()]
    got = mapreduce.iterate(store, mapper, lambda k, vs: {k: sum(vs)}, 2)
    assert {r.k: r.out for r in got.collect()} == {"2": '{"2": 2}', "1": '{"1": 2}'}


def test_deleting_an_absent_key_is_an_error(spark):
    from weft.operators import kv

    t = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "gid string, key string, value int")
    left, gone = kv.delete_key(t, "a", "g")
    assert [r.key for r in left.collect()] == ["b"] and [r.value for r in gone.collect()] == [1]
    with pytest.raises(KeyError):
        kv.delete_key(t, "a", "other")


def test_crawl_summary(spark):
    from weft.operators import crawl

    visits = spark.createDataFrame([("u1", 0, True, True), ("u2", 1, True, False), ("u3", 1, False, False)], "url string, depth int, fetched boolean, indexed boolean")
    texts = spark.createDataFrame([("u1", "one two"), ("u2", "three")], "url string, text string")
    terms = spark.createDataFrame([("u1", "one"), ("u1", "two"), ("u2", "three")], "url string, term string")
    got = crawl.crawl_summary(visits, texts, texts, terms).first()
    assert got.asDict() == {"pages_visited": 3, "pages_fetched": 2, "docs_indexed": 1, "text_chars": 7, "unique_terms": 2, "sample_docs": ["u1"]}


def test_shard_of_a_literal(spark):
    from pyspark.sql import functions as F

    from weft.operators import index

    words = ["", "a", "thing", "über", "a b c", "x" * 100]
    for n in (1, 7, 16, 64):
        got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(index.shard_number(F.col("t"), n)).collect()]
        assert got == [index.shard_of_literal(w, n) for w in words]
