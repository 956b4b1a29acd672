"""Benchmark statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, sd_pop, mn, mx of a column (all 0 without rows), by groups if given."""
    zero = F.lit(0.0)
    return rows.groupBy(*(by or [])).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), zero).alias("mean"),
        F.coalesce(F.stddev_pop(value), zero).alias("sd_pop"),
        F.coalesce(F.min(value), zero).alias("mn"),
        F.coalesce(F.max(value), zero).alias("mx"),
    )


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "success")


def node_counts(values: list) -> list[int]:
    """Finite counts of at least one, without repeats, in order."""
    out = []
    for v in values:
        try:
            n = int(float(v))
        except (TypeError, ValueError, OverflowError):
            continue
        if n >= 1 and n not in out:
            out.append(n)
    return out


def throughput(items: Column, ms: Column) -> Column:
    return F.when(ms > 0, items * 1000 / ms).otherwise(F.lit(0.0))


def bottleneck(rows: DataFrame, value: str = "throughput") -> DataFrame:
    """The least positive throughput (0 if there is none)."""
    return rows.agg(F.coalesce(F.min(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("bottleneck"))


def diff_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """ratio: the larger of the two one-sided set differences over the size of the first set. Rows are compared whole."""
    tagged = a.distinct().withColumn("_s", F.lit(1)).unionByName(b.distinct().withColumn("_s", F.lit(2)))
    sides = tagged.groupBy(*a.columns).agg(F.sum("_s").alias("_s"))
    n = lambda *s: F.sum(F.when(F.col("_s").isin(*s), 1).otherwise(0))
    return sides.agg((F.greatest(n(1), n(2)) / n(1, 3)).alias("ratio"))


def node_status(rows: DataFrame) -> DataFrame:
    """Heap summed over nodes, ids collected."""
    return rows.agg(F.sum("heap_total").alias("heap_total"), F.sort_array(F.collect_list("nid")).alias("nids"), F.sort_array(F.collect_list("sid")).alias("sids"))
