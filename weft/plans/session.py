"""Session settings the engine is tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Adaptive execution sizes partitions at run time; skewed joins are split.
CLUSTER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, set from spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = os.path.join(tempfile.gettempdir(), "weft-checkpoint")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "weft") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=CLUSTER)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
