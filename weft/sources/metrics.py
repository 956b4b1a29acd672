"""Metrics sinks: CSV rows, a JSON summary, and a checkpoint of finished stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "component string, latency_ms double, throughput_per_sec double, samples int, unit string"


def metrics(spark: SparkSession, rows: list[tuple[str, float, int, str]]) -> DataFrame:
    """(component, total ms, samples, unit) -> metric rows."""
    held = spark.createDataFrame(rows, "component string, ms double, samples int, unit string")
    return held.select(
        "component",
        F.when(F.col("samples") > 0, F.col("ms") / F.col("samples")).otherwise(0.0).alias("latency_ms"),
        F.when(F.col("ms") > 0, F.col("samples") * 1000 / F.col("ms")).otherwise(0.0).alias("throughput_per_sec"),
        "samples",
        "unit",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def checkpoint_stage(rows: DataFrame, path: str, stage: str) -> None:
    """Rows of one stage; writing it again replaces it and leaves the others."""
    rows.withColumn("stage", F.lit(stage)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)
