"""Keyed tables that are kept: Parquet, a directory for each node and bucket of keys.

A key's node is the placement function's, as in weft.operators.kv; its bucket is a hash.
A write rewrites the buckets of the keys it names and no others, by Spark's dynamic
partition overwrite; a get lists one bucket. When the group of nodes changes, only
buckets that lose or gain keys are rewritten. Writers of one table take turns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.hashing import HASHERS, content_id
from weft.operators import kv

_PLACE = ["nid", "bucket"]
#: Buckets of one node.
BUCKETS = 32


def _bucket(gid: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gid, key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Table:
    """A stored table. nids: the nodes of its group; schema: its columns, as DDL, gid and key among them."""

    spark: SparkSession
    path: str
    nids: tuple[str, ...]
    schema: str
    hasher: str = "naive"
    buckets: int = BUCKETS

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, nids: list[str], hasher: str = "naive", buckets: int = BUCKETS) -> Table:
        """An empty table; one that is there is replaced. schema: columns beside gid and key."""
        out = Table(spark, path, tuple(nids), f"gid string, key string, {schema}", hasher, buckets)
        out._write(spark.createDataFrame([], out.schema), overwrite="all")
        return out._remember()

    @staticmethod
    def open(spark: SparkSession, path: str) -> Table:
        held = json.loads(spark.read.text(f"{path}/manifest").first().value)
        return Table(spark, path, tuple(held["nids"]), held["schema"], held["hasher"], held["buckets"])

    def _remember(self) -> Table:
        held = {"nids": list(self.nids), "schema": self.schema, "hasher": self.hasher, "buckets": self.buckets}
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        return self

    # ---- places

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"nid": HASHERS[self.hasher](content_id(F.col("key")), list(self.nids)), "bucket": _bucket(F.col("gid"), F.col("key"), self.buckets)})

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, nid string, bucket int").parquet(f"{self.path}/rows")

    def _in(self, places: list[tuple[str, int]]) -> DataFrame:
        """The rows of some buckets; others are not listed."""
        if not places:
            return self._stored().where(F.lit(False))
        by: dict[str, list[int]] = {}
        for nid, bucket in places:
            by.setdefault(nid, []).append(bucket)
        wanted = F.lit(False)
        for nid, own in sorted(by.items()):
            wanted = wanted | ((F.col("nid") == nid) & F.col("bucket").isin(sorted(own)))
        return self._stored().where(wanted)

    def _touched(self, placed: DataFrame) -> list[tuple[str, int]]:
        """At most nodes x buckets."""
        return [(r.nid, r.bucket) for r in placed.select(*_PLACE).distinct().collect()]

    def _write(self, rows: DataFrame, places: list[tuple[str, int]] = (), overwrite: str = "places") -> None:
        """rows replace what is in `places`. A row without a key marks each, so that a bucket that became empty is overwritten as well."""
        marks = self.spark.createDataFrame([tuple(p) for p in places], "nid string, bucket int")
        whole = rows.unionByName(marks, allowMissingColumns=True) if places else rows
        if overwrite == "all":
            whole = whole.withColumns({c: F.lit(None).cast(t) for c, t in (("nid", "string"), ("bucket", "int")) if c not in whole.columns})
        by_place = whole.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "gid", "key")
        mode = "static" if overwrite == "all" else "dynamic"
        by_place.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*_PLACE).parquet(f"{self.path}/rows")

    def _rewrite(self, writes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[tuple[str, int]]:
        """change(rows of the touched buckets, writes) in their place."""
        placed = self._placed(writes)
        places = self._touched(placed)
        if places:
            held = self._in(places).where("key IS NOT NULL")
            self._write(self._placed(change(held.drop(*_PLACE), writes)), places)
        return places

    # ---- operations

    def rows(self) -> DataFrame:
        """The table."""
        return self._stored().where("key IS NOT NULL").drop(*_PLACE)

    def placed_rows(self) -> DataFrame:
        """The table with the node and the bucket in which each row lies."""
        return self._stored().where("key IS NOT NULL")

    def put(self, writes: DataFrame, seq: str = "seq") -> list[tuple[str, int]]:
        """writes replace the rows of their keys, the highest `seq` of a key's writes last; a null key is the value's content address. Returns the buckets rewritten."""
        own = kv.last_writes(kv.addressed(writes), seq).select(*self._names())
        return self._rewrite(own, lambda held, new: held.join(new.select(*kv.KEY), kv.KEY, "left_anti").unionByName(new))

    def append(self, writes: DataFrame, value: str = "values", seq: str = "seq") -> list[tuple[str, int]]:
        """The values of writes (gid, key, `value` array, `seq`), in order of seq, behind those of their keys."""
        new = kv.append(writes.select(*kv.KEY, F.col(value).alias("value"), seq), seq, flatten=True).withColumnRenamed("values", value)

        def joined(held: DataFrame, new: DataFrame) -> DataFrame:
            both = held.select(*kv.KEY, F.col(value).alias("_a")).join(new.withColumnRenamed(value, "_b"), kv.KEY, "full")
            none = F.array().cast(held.schema[value].dataType)
            return both.select(*kv.KEY, F.concat(F.coalesce("_a", none), F.coalesce("_b", none)).alias(value))

        return self._rewrite(new, joined)

    def delete(self, gone: DataFrame) -> list[tuple[str, int]]:
        """The rows of keys (gid, key) go; absent ones are ignored."""
        return self._rewrite(gone.select(*kv.KEY).distinct(), lambda held, gone: held.join(gone, kv.KEY, "left_anti"))

    def get(self, key: str | None, gid: str = "local") -> DataFrame:
        """The row of a key, with its absence an error, read from its bucket alone; a null key lists the group's keys."""
        if key is None:
            return kv.keys(self.rows(), gid)
        place = self._placed(self.spark.createDataFrame([(gid, key)], "gid string, key string")).first()
        return kv.get(self._in([(place.nid, place.bucket)]).drop(*_PLACE), key, gid)

    def delete_key(self, key: str, gid: str = "local") -> DataFrame:
        """get(), then delete(): the row that was there, as a table of its own."""
        gone = self.spark.createDataFrame(self.get(key, gid).collect(), self.schema)
        self.delete(gone)
        return gone

    def reconf(self, nids: list[str]) -> tuple[Table, list[tuple[str, int]]]:
        """(the table over other nodes, the buckets rewritten).

        A bucket is rewritten if one of its keys has another node now, or if a key comes to it; other buckets are
        neither read whole - only their keys are - nor written. Rows whose node left go with its directory's rows.
        """
        new = replace(self, nids=tuple(nids))
        held = self._stored().where("key IS NOT NULL")
        moved = held.select(F.col("nid").alias("was"), "gid", "key").transform(new._placed).where("was <> nid")
        pairs = [(r.was, r.nid, r.bucket) for r in moved.select("was", "nid", "bucket").distinct().collect()]
        places = sorted({(p, b) for was, now, b in pairs for p in (was, now)})
        if places:
            new._write(new._placed(self._in(places).where("key IS NOT NULL").drop(*_PLACE)), places)
        return new._remember(), places

    def _names(self) -> list[str]:
        return self._stored().drop(*_PLACE).columns
