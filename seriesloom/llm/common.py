"""What the operators of this subpackage share: input columns and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow function takes at once, but for a single longer text.
PART_BYTES = 1 << 20
#: A group of this many rows is large; the parts to which the rows of a large group are dealt.
LARGE, PARTS = 1_000, 64
#: Column of a row's locator, the file and row in which it lies, beside the columns of documents.
PLACE = "__locator"

#: Rows of an Arrow batch between Spark and Python: texts are long, and a batch is in memory several times.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Folders made by shared_path(), by application, for discard().
_made: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which the driver and all executors can reach.

    Where the setting is absent, a local session (tests) gets a folder under the temporary directory in its place;
    on a cluster that is an error, as each machine would have a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "seriesloom-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Deletes the folders that shared_path() has named so far in this application, but for `keep`.

    For callers that have written or collected what they wanted: results that are still lazy read these folders.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in paths:
        if path in keep:
            _made.setdefault(spark.sparkContext.applicationId, []).append(path)
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(conf).delete(where, True))
    return gone


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver drop what earlier jobs have left: plans, and by Spark's cleaner their shuffle files and broadcasts,
    which go only when the driver's memory is collected. For callers between two long steps."""
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    bound_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """`docs` with each row's locator. Rows that do not come straight from files that Spark can number the rows of are
    first written to the shared folder."""
    bound_batches(docs.sparkSession)
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(PLACE)
    try:
        return docs.select(*[docs[f"`{c}`"] for c in docs.columns], place)
    except AnalysisException:
        kept = stored(docs, "documents")
        return kept.select(*[kept[f"`{c}`"] for c in kept.columns], place)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most PART_BYTES of one column of text; a longer text is a part of its own."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        begin = 0
        while begin < len(size):
            before = size[begin - 1] if begin else 0
            end = max(int(np.searchsorted(size, before + PART_BYTES, side="right")), begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its JVM


def meet(rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: str) -> DataFrame:
    """`rows` joined with the one row of `groups` that has their values of `on`; no large group lands in one task.

    groups[size] says how many rows a group has. Rows are dealt to parts by a hash of the column `spread`, and large
    groups, of which there is at most one for each LARGE rows, stand in every part; rows that meet none of them
    join the others by `on` alone.
    """
    known = [c for c in groups.columns if c not in on]
    parts = groups.where(F.col(size) >= LARGE).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int"))
    met = dealt.join(parts.hint("merge"), [*on, "__part"], "left").drop("__part")
    rest = met.where(F.col(size).isNull()).drop(*known).join(groups.where(F.col(size) < LARGE), on)
    return met.where(F.col(size).isNotNull()).unionByName(rest)
