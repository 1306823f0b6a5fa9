"""Writers of the output formats. Spark's committers make each write whole or absent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import pending
from .readers import read_records
from .scratch import stored


#: Records of a file: a compressed one is read by one task.
FILE_RECORDS = 1 << 17


def write_records(records: DataFrame, path: str, mode: str = "overwrite", partitioned: bool = False, compression: str = "gzip") -> None:
    """Caption records as JSON lines; with `partitioned` one folder a dataset. Most of a record is names of fields and
    nulls, so files are compressed; "none" leaves them plain."""
    writer = records.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS)
    (writer.partitionBy("dataset") if partitioned else writer).json(path)


def _folder(spark: SparkSession, path: str):
    """(the file system of `path`, its Hadoop path)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The commit log beside `path`: folder, stream, rows, low and high (series_key) of each batch."""
    kinds = "folder string, rows long, low string, high string, stream string, batch string"
    if not _names(spark, f"{path}.commits"):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).json(f"{path}.commits")


def append_records(records: DataFrame, path: str, stream: str | None = None, batch: int = 0) -> None:
    """Appends the records that are not yet below `path`, by series and span; safe to repeat after a failure.

    Each batch is a folder of its own, replaced if the batch comes again, and then a row of the commit log beside
    `path`. The batches of one `stream` hold different records, so none of its earlier ones is read. What other
    streams, single calls (without `stream`) and write_records() have left is compared: of logged batches, those whose
    range of keys meets the new one's.
    """
    spark = records.sparkSession
    own = stream or uuid.uuid4().hex
    folder = f"batch-{own}-{batch}"
    unlogged = [n for n in _names(spark, path) if not n.startswith(("_", ".", "batch-"))]
    others = [n for n in _names(spark, f"{path}.commits") if n.startswith("stream=") and n != f"stream={own}"]
    if unlogged or others:
        records = stored(records, "records")
        span = records.agg(F.min("series_key").alias("low"), F.max("series_key").alias("high")).first()
        near = committed(spark, path).where((F.col("stream") != own) & (F.col("low") <= span.high) & (F.col("high") >= span.low)).select("folder").collect() if span.low is not None else []
        folders = [f"{path}/{r.folder}" for r in near] + [f"{path}/{n}" for n in unlogged]
        if folders:
            pair = lambda df: df.select(F.col("series_key").alias("k"), F.col("indices")[0].alias("a"), F.col("indices")[1].alias("b"))
            known = pair(read_records(spark, *folders)).distinct()
            marked = records.withColumns({"k": F.col("series_key"), "a": F.col("indices")[0], "b": F.col("indices")[1]})
            records = pending(marked, known, ("k", "a", "b")).select(*records.columns)
    write_records(records, f"{path}/{folder}")
    log = read_records(spark, f"{path}/{folder}").agg(F.lit(folder).alias("folder"), F.count("*").alias("rows"), F.min("series_key").alias("low"), F.max("series_key").alias("high"))
    log.coalesce(1).write.mode("overwrite").json(f"{path}.commits/stream={own}/batch={batch}")


def write_sft(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fine-tuning rows as JSON lines."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_predictions(rows: DataFrame, metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions as JSON lines below `path`/predictions and metric means (metric, mean) as one object below `path`/metrics."""
    rows.write.mode(mode).json(f"{path}/predictions")
    one = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("metrics"))
    one.coalesce(1).write.mode(mode).json(f"{path}/metrics")
