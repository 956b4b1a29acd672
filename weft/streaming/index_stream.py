"""Incremental index maintenance and frontier dedup with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from weft.operators.index import build_index


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files of a table, a few a micro-batch. path may be a folder or a single file, which a pattern of one name picks out of its folder."""
    path = path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/[{name[0]}]{name[1:]}" if single else path)


def maintain_index(docs: DataFrame, path: str, checkpoint: str, doc: str = "doc_id") -> StreamingQuery:
    """Each micro-batch's counts are written as one part of the index, named by the batch.

    A repeated batch replaces its own part, so the result is exactly once. The index is
    the sum of the parts (read_maintained); compact() folds them. No term is held as state.
    """

    def add(batch: DataFrame, number: int) -> None:
        build_index(batch, doc).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Documents of several batches that are broadcast, at most.
TOLD = 1_000_000


def read_maintained(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """(term, doc, cnt): the sum of the parts. Only the rows of documents that came in several batches are shuffled, unless these are over TOLD."""
    parts = spark.read.parquet(path)
    summed = lambda rows: rows.groupBy("term", doc).agg(F.sum("cnt").alias("cnt"))
    if "batch" not in parts.columns:
        return summed(parts)
    again = parts.groupBy(doc).agg((F.min("batch") < F.max("batch")).alias("again")).where("again").select(F.col(doc).alias("_again"))
    n = again.limit(TOLD + 1).count()
    if n > TOLD:
        return summed(parts)
    rows = parts.select("term", doc, "cnt")
    if not n:
        return rows
    same = F.col(doc).eqNullSafe(F.col("_again"))
    return rows.join(F.broadcast(again), same, "left_anti").unionByName(summed(rows.join(F.broadcast(again), same, "left_semi")))


def compact(spark: SparkSession, path: str, to: str, doc: str = "doc_id") -> DataFrame:
    """The parts folded into one table at `to`."""
    read_maintained(spark, path, doc).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def frontier(links: DataFrame, watermark: str | None = None, at: str = "ts") -> DataFrame:
    """Urls not seen before in the stream. With a watermark the state is bounded by time."""
    return links.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["url"]) if watermark else links.dropDuplicates(["url"])


def due_visits(links: DataFrame, every: str, visits: int = 2, late: str = "0 seconds", at: str = "ts") -> DataFrame:
    """(url, visit, due) of a stream (url, `at`): each url when it is first seen, and again each `every` of event time, `visits` times in all.

    The state of a url is its number of visits and the time of the next, and goes with its last visit; a link to a
    known url adds nothing. Timers fire as the watermark passes them, `late` behind the stream's newest time.
    """
    step = int(pd.Timedelta(every).total_seconds() * 1000)
    if step <= 0 or visits < 1:
        raise ValueError("every must be positive and visits at least 1")

    def visit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            done, next_ = state.get
            watermark = state.getCurrentWatermarkMs()
            while done < visits and next_ <= watermark:  # one event may pass several visits
                done += 1
                out.append((key[0], done, pd.Timestamp(next_, unit="ms")))
                next_ += step
        else:
            seen = min(int(f["ms"].min()) for f in frames)
            if state.exists:
                done, next_ = state.get
            else:
                done, next_ = 1, seen + step
                out.append((key[0], 1, pd.Timestamp(seen, unit="ms")))
        if done >= visits and state.hasTimedOut:
            state.remove()
        else:
            state.update((done, next_))
            state.setTimeoutTimestamp(max(next_, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["url", "visit", "due"]).astype({"visit": "int32", "due": "datetime64[ns]"})

    rows = links.withWatermark(at, late).select("url", at, F.unix_millis(F.col(at).cast("timestamp")).alias("ms"))
    return rows.groupBy("url").applyInPandasWithState(visit, "url string, visit int, due timestamp", "done int, next bigint", "append", "EventTimeTimeout")


def until_stop(urls: DataFrame) -> DataFrame:
    """The rows of a batch (url, n) before the literal `stop`."""
    end = urls.where(F.col("url") == "stop").agg(F.min("n").alias("end"))
    return urls.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.col("n") < F.col("end"))).drop("end")


def drain_until_stop(urls: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the stream's (url, n) before the first `stop` to the table at path; batches after it add nothing.

    every: a trigger period such as "5 seconds" for a query that goes on; else what is there is read and the query ends.
    """
    flag = f"{path}_stopped"

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{flag}/batch")
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop) and spark.read.text(f"{flag}/batch").first().value != str(number):
            return
        until_stop(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if not batch.where(F.col("url") == "stop").isEmpty():
            spark.createDataFrame([(str(number),)], "value string").coalesce(1).write.mode("overwrite").text(f"{flag}/batch")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return urls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counts(events: DataFrame, key: str) -> DataFrame:
    """Running count by key."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(events: DataFrame, key: str, at: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count(F.lit(1)).alias("cnt"))
