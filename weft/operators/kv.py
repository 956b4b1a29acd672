"""Keyed tables: put, get, delete, append, list, re-placement.

A table is a DataFrame (gid, key, value, ...), unique on the pair (gid, key); a log of
writes becomes a table by folding it. A null key is the content address of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.hashing import HASHERS, content_id

KEY = ["gid", "key"]


def addressed(writes: DataFrame, group: str = "local") -> DataFrame:
    """writes with gid and key filled in."""
    gid = F.coalesce("gid", F.lit(group)) if "gid" in writes.columns else F.lit(group)
    return writes.withColumns({"gid": gid, "key": F.coalesce(F.col("key"), content_id(F.col("value")))})


def last_writes(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """The row with the highest seq of each key: a put overwrites. Partial maxima, no sort."""
    others = [c for c in writes.columns if c not in KEY]
    top = writes.groupBy(*KEY).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
    return top.select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in others])


def put(table: DataFrame, writes: DataFrame, seq: str = "seq") -> DataFrame:
    """table after the writes."""
    fresh = last_writes(writes, seq).select(*table.columns)
    return table.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh)


def get(table: DataFrame, key: str | None, gid: str = "local") -> DataFrame:
    """The row of a key, with its absence an error; a null key lists the group's keys."""
    if key is None:
        return keys(table, gid)
    found = table.where((F.col("gid") == gid) & (F.col("key") == key))
    if found.isEmpty():
        raise KeyError(f"key {key} not found")
    return found


def keys(table: DataFrame, gid: str = "local") -> DataFrame:
    return table.where(F.col("gid") == gid).select("key")


def delete(table: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, what was deleted)."""
    return table.join(gone, KEY, "left_anti"), table.join(gone, KEY, "left_semi")


def delete_key(table: DataFrame, key: str, gid: str = "local") -> tuple[DataFrame, DataFrame]:
    """delete() of one key, with its absence an error."""
    gone = get(table, key, gid)
    return table.where(~((F.col("gid") == gid) & (F.col("key") == key))), gone


def append(writes: DataFrame, seq: str = "seq", flatten: bool = False) -> DataFrame:
    """(gid, key, values): all values of a key in order of seq. With flatten, array values are concatenated one level."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("value").alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return writes.groupBy(*KEY).agg((F.flatten(values) if flatten else values).alias("values"))


def place(key: Column, nids: list[str], hasher: str = "naive") -> Column:
    """The node that owns a key."""
    return HASHERS[hasher](content_id(key), nids)


def moved(rows: DataFrame, key: str, old: list[str], new: list[str], hasher: str = "naive") -> DataFrame:
    """(k, old_nid, new_nid) of the keys that change nodes when the group does."""
    k = F.col(key).cast("string")
    return rows.select(k.alias("k"), place(k, old, hasher).alias("old_nid"), place(k, new, hasher).alias("new_nid")).where("old_nid <> new_nid")
