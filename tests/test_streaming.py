from pyspark.sql import functions as F

from weft.operators.index import build_index
from weft.streaming import index_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "docs")
    docs = spark.createDataFrame([(i, f"alpha beta gamma{chr(97 + i)} {'delta ' * i}") for i in range(9)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(src)
    where, log = str(tmp_path / "idx"), str(tmp_path / "log")

    def drain():
        index_stream.maintain_index(index_stream.document_stream(spark, src, docs.schema), where, log).awaitTermination()

    drain()
    whole = rows(build_index(docs))
    assert rows(index_stream.read_maintained(spark, where)) == whole
    drain()  # nothing new
    assert rows(index_stream.read_maintained(spark, where)) == whole
    more = spark.createDataFrame([(1, "alpha"), (99, "omega")], docs.schema)
    more.write.mode("append").parquet(src)
    drain()
    assert rows(index_stream.read_maintained(spark, where)) == rows(build_index(docs.unionByName(more)))
    assert rows(index_stream.compact(spark, where, str(tmp_path / "one"))) == rows(build_index(docs.unionByName(more)))


def test_until_stop(spark):
    df = spark.createDataFrame([("a", 1), ("stop", 2), ("b", 3)], "url string, n bigint")
    assert [r.url for r in index_stream.until_stop(df).collect()] == ["a"]
    assert index_stream.until_stop(df.where("url <> 'stop'")).count() == 2


def test_batch_forms(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 01:10:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(index_stream.counts(df, "k")) == [("a", 2), ("b", 1)]
    assert sorted(r.cnt for r in index_stream.windowed_counts(df, "k").collect()) == [1, 2]
    links = df.withColumnRenamed("k", "url")
    assert index_stream.frontier(links).count() == 2


def test_frontier_state_is_bounded_by_time(spark, tmp_path):
    src = str(tmp_path / "links")
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 00:15:00")], "url string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    stream = index_stream.frontier(index_stream.document_stream(spark, src, df.schema), "1 hour")
    q = stream.writeStream.format("memory").queryName("frontier").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("frontier").collect()) == ["a", "b"]


def test_frontier_ends_at_stop(spark, tmp_path):
    from weft.streaming import index_stream

    for i, urls in enumerate([["a", "b"], ["c", "stop", "d"], ["e"]]):
        spark.createDataFrame([(u, 10 * i + k) for k, u in enumerate(urls)], "url string, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = index_stream.document_stream(spark, str(tmp_path / "in"), "url string, n bigint")
    index_stream.drain_until_stop(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {"a", "b", "c"} <= got and not got & {"d", "stop"}
    periodic = index_stream.drain_until_stop(stream, str(tmp_path / "out2"), str(tmp_path / "log2"), every="1 second")
    try:
        periodic.processAllAvailable()
    finally:
        periodic.stop()
    assert {r.url for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == got
