"""Folders that driver and executors share, and tables staged in them to cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that an Arrow batch to a Python worker holds, a row at least.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES at most, as long texts make batches of a number of rows large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != f"{BATCH_BYTES}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the driver ends; where that is unset and all runs in one process, under a folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        top = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[app] = top
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
