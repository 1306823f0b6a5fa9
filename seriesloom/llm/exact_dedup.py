"""Exact deduplication with disk-backed streaming state.

Arrivals are fingerprinted (SHA-256 of the text with A-Z lower-cased) into a thin feed of digest, identifier and
locator, the file and row in which the content lies. A streaming aggregation over the feed keeps, per digest and
without expiry, the number of rows, the largest identifier and its locator; RocksDB holds that state on disk and
the checkpoint in the shared folder carries it from call to call. Digests that more than one row shares are hits:
their full bytes are fetched by locator and compared before the result is given.

A group that holds a third of all rows is no hot spot: the feed is aggregated within tasks before its shuffle,
rows of large groups are dealt to many parts when they learn their group, and equal bytes of a task are one row
before bytes are compared across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, located, meet, shared_path, stored

FEED = "id long, digest string, n_bytes long, locator string"
GROUP = ["digest", "n_bytes"]


def sha256_hex(normalized: bytes) -> str:
    return hashlib.sha256(normalized).hexdigest()


def _prints(digest: Callable[[bytes], str], bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]  # bytes: A-Z only
            columns = [batch.column(0), pa.array([digest(t) for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(2)]
            names = ["id", "digest", "n_bytes", "locator"]
            if bodies:
                columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "body"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _rows(places: DataFrame, text: str, key: str) -> DataFrame:
    return places.select(places[key].cast("long").alias("id"), places[text].cast("string").alias("t"), F.col(PLACE).alias("locator"))


def arrive(docs: DataFrame, feed: str, digest: Callable[[bytes], str] = sha256_hex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Appends the fingerprints of `docs` to the feed; returns `docs` with the locators that the feed names."""
    places = located(docs)
    _rows(places, text, key).mapInArrow(_prints(digest, bodies=False), FEED).write.mode("append").parquet(feed)
    return places


def consume(spark: SparkSession, feed: str, state: str) -> None:
    """Takes what is new in the feed into the keyed state below `state`; each file counts once.

    The groups that changed are written below `state`/groups, one folder a batch, rewritten if a batch is retried.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores
    arrivals = own.readStream.schema(FEED).parquet(feed)
    groups = arrivals.groupBy(*GROUP).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.struct("id", "locator")).alias("kept_at"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/groups/batch={number}")

    query = groups.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def known_groups(spark: SparkSession, state: str) -> DataFrame:
    """digest, n_bytes, keep_id, group_size, kept_at (the locator of the row that stays) of every group so far."""
    schema = "digest string, n_bytes long, keep_id long, group_size long, kept_at struct<id: long, locator: string>"
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state}/groups")
    latest = read.groupBy(*GROUP).agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("kept_at").alias("kept_at"))
    return latest.withColumn("kept_at", F.col("kept_at.locator"))


def _fetched(places: DataFrame, wanted: DataFrame, digest: Callable[[bytes], str], text: str, key: str) -> DataFrame:
    """The full bytes of the rows whose locators are wanted: id, digest, n_bytes, locator, body."""
    rows = _rows(places, text, key).join(wanted.select("locator"), "locator", "left_semi").select("id", "t", "locator")
    return rows.mapInArrow(_prints(digest, bodies=True), FEED + ", body binary")


def _grouped(docs: DataFrame, digest: Callable[[bytes], str], text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """`docs` with locators, and per row: id, digest, n_bytes, locator, keep_id, group_size, kept_at."""
    spark = docs.sparkSession
    feed, state = shared_path(spark, "dedup-feed"), shared_path(spark, "dedup-state")
    places = arrive(docs, feed, digest, text, key)
    consume(spark, feed, state)
    named = stored(meet(spark.read.schema(FEED).parquet(feed), known_groups(spark, state), GROUP, "group_size", "locator"), "dedup-named")

    bodies = _fetched(places, named.where("group_size > 1"), digest, text, key)
    kinds = bodies.select(*GROUP, "body").distinct()  # a task's equal bytes are one row before they are shuffled
    clashes = stored(kinds.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1").select(*GROUP), "dedup-clashes")
    if clashes.isEmpty():
        return places, named
    # the digest, not the text, is to blame: these few digests' groups are formed anew on the full bytes
    odd = _fetched(places, named.join(clashes, GROUP, "left_semi"), digest, text, key)
    exact = odd.groupBy(*GROUP, "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.struct("id", "locator"))["locator"].alias("kept_at"))
    redone = odd.join(exact, [*GROUP, "body"]).select(*named.columns)
    return places, named.join(clashes, GROUP, "left_anti").unionByName(redone)


def exact_duplicates(docs: DataFrame, digest: Callable[[bytes], str] = sha256_hex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest key stays; a row that repeats both key and text is marked kept as well (drop_duplicates() leaves one).
    Null keys lose against any other; a group of null keys has keep_id null and is kept. An empty table gives no
    rows. Other columns are not read. If texts that share a digest differ, their groups are formed anew on the full bytes.
    """
    _, named = _grouped(docs, digest, text, key)
    return named.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, digest: Callable[[bytes], str] = sha256_hex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: exactly one for each text, the one that the state locates.

    That is the row of the largest key, null keys last; of rows that repeat both key and text, the one that lies
    last in the files. Rows that share a key but not the text are apart from each other.
    """
    places, named = _grouped(docs, digest, text, key)
    stays = named.where(F.col("locator") == F.col("kept_at")).select(F.col("locator").alias(PLACE))
    return places.join(stays, PLACE, "left_semi").select(*[places[f"`{c}`"] for c in docs.columns])
