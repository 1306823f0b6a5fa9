"""Intermediate tables in a folder that the driver and all executors can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders named by shared_path(), by application, for discard().
_made: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; a local session without it uses the temporary directory."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "seriesloom-shared")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the folders named so far in this application; for callers that have their results. Their number."""
    gone = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    return gone
