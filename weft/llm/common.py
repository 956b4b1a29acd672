"""Shared helpers of the llm operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

LONG_MIN = -(2**63)
M64 = (1 << 64) - 1
#: Bytes of one Arrow batch that Spark hands to a worker, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = os.path.join(tempfile.gettempdir(), "weft-checkpoint")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: a reliable checkpoint in the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(column: str) -> Column:
    """The column of that very name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def extended(fields: list[StructField], ddl: str) -> StructType:
    """A schema of these fields, whatever their types hold, and those of a DDL text."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that the table does not use."""
    name = prefix
    while name.lower() in {c.lower() for c in taken}:
        name = f"{prefix}_{uuid.uuid4().hex[:6]}"
    return name


def _release() -> None:
    """Freed memory goes back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker gives its memory back after the task."""

    def call(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return call


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded in bytes, not only in rows."""
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, "64m").lower() in ("64m", "67108864", "67108864b"):
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)
