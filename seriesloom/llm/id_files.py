"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file is a run of segments. A segment holds the ids of consecutive documents as one little-endian array (two
bytes an id where the vocabulary allows it) and two Elias-Fano sequences: where each document ends, and the
documents' keys in ascending order. No table of 64-bit offsets is stored or made. Each sequence has a select
directory, the bit of every 256th value in 32 bits: `select` jumps to the nearest such bit and counts on from
there, and every boundary that is read comes from it. Segments are rows of Parquet files, so Spark's own
committers, file systems and retries apply.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import chunks, encoder, with_ends

#: Ids after which a segment ends (a longer document stands alone in its segment).
SEGMENT_IDS = 1 << 20
#: Values from one entry of the select directory to the next; documents that are read at once.
SAMPLE, READ_DOCS = 256, 16 * 256
SCHEMA = (
    "shard int, segment int, n_docs long, n_ids long, width int, ids binary, ends_low binary, ends_high binary, ends_select binary, "
    "n_null long, first_key long, keys_last long, keys_low binary, keys_high binary, keys_select binary"
)


@dataclass
class EliasFano:
    """A non-decreasing sequence of n integers in [0, last]: l low bits each, the rest in unary (`high`).

    directory: little-endian 32-bit numbers, the bit in `high` of the values 0, SAMPLE, 2 * SAMPLE, ...
    """

    n: int
    last: int
    low: bytes
    high: bytes
    directory: bytes

    @staticmethod
    def low_bits(n: int, last: int) -> int:
        return max(0, (int(last + 1) // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = np.asarray(values, np.uint64)
        last = int(values[-1])
        bits = cls.low_bits(n, last)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, last, np.packbits(low.astype(np.uint8).ravel()).tobytes(), np.packbits(high).tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits = self.low_bits(self.n, self.last)
        if not bits:
            return np.zeros(len(i), np.uint64)
        raw = np.frombuffer(self.low, np.uint8)
        at = np.asarray(i, np.int64)[:, None] * bits + np.arange(bits)
        one = (raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return (one.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, begin: int, end: int) -> np.ndarray:
        """Values number begin to end - 1: from the directory's bit before the first to that after the last."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        directory = np.frombuffer(self.directory, "<u4")
        first, stop = begin // SAMPLE, -(-end // SAMPLE)
        bit = int(directory[first])
        until = int(directory[stop]) if stop < len(directory) else 8 * len(self.high)
        raw = np.unpackbits(np.frombuffer(self.high, np.uint8, -(-until // 8) - bit // 8, bit // 8))
        ones = np.flatnonzero(raw[bit % 8 :])[begin - first * SAMPLE :][: end - begin] + bit
        i = np.arange(begin, end)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits(self.n, self.last)) | self._low(i)


def _segment(shard: int, segment: int, keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """A row of a file: documents by keys (nulls first), their ids, and where each ends."""
    nulls = keys.null_count
    known = np.asarray(keys.slice(nulls), np.int64)
    first = int(known[0]) if len(known) else 0
    place, key = EliasFano.encode(ends), EliasFano.encode((known - first).astype(np.uint64))
    row = [shard, segment, len(keys), place.last, ids.dtype.itemsize, ids.tobytes(), place.low, place.high, place.directory, nulls, first, key.last, key.low, key.high, key.directory]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(row, fields, strict=True)], [n for n, _ in fields])


def write_id_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Writes the ids of all documents, each followed by `end_id`, in ascending key order below `path`.

    Documents are dealt by ranges of the key and a hash of the text, so that a key that very many rows share is
    no single range; each range is a shard, written as it is encoded, a segment at a time. Null keys come first,
    equal keys in the order of that hash, then of their texts; a null text is empty (the end id alone). Other columns are not read; an
    empty table gives files without segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        shard, segment = TaskContext.get().partitionId(), 0
        kind = "<u2" if getattr(enc, "tokenizer", None) and max(enc.tokenizer.get_vocab_size(), end_id) <= 0xFFFF else "<u4"
        keys, ids, ends = pa.array([], pa.int64()), np.zeros(0, kind), np.zeros(0, np.int64)
        for batch in chunks(batches, 1):
            more, offsets = with_ends(*enc.encode(batch.column(1)), end_id)
            keys, ends = pa.concat_arrays([keys, batch.column(0)]), np.concatenate((ends, offsets[1:] + len(ids)))
            ids = np.concatenate((ids, more.astype(kind)))
            done = at = 0
            while len(ids) - at > SEGMENT_IDS:
                until = max(int(np.searchsorted(ends, at + SEGMENT_IDS, side="right")), done + 1)
                if until == len(ends):
                    break
                yield _segment(shard, segment, keys.slice(done, until - done), ids[at : ends[until - 1]], ends[done:until] - at)
                segment, done, at = segment + 1, until, int(ends[until - 1])
            keys, ids, ends = keys.slice(done), ids[at:], ends[done:] - at
        if len(keys):
            yield _segment(shard, segment, keys, ids, ends)

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments of written id files."""
    return spark.read.schema(SCHEMA).parquet(path)


def document_table(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids before it in all files), n_tokens, ids_crc32.

    Boundaries and keys come from select on the Elias-Fano sequences, a few thousand documents at a time. The ids
    before a segment are sums over shards and over the segments of a shard, two small tables of counts (one row a
    shard, at most one for each two million ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "segment", "k", "local", "n_tokens", "ids_crc32"]
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                raw = {c: v.as_buffer() for c, v in r.items() if pa.types.is_binary(v.type)}
                n, nulls, width, shard, segment, first = (r[c].as_py() for c in ("n_docs", "n_null", "width", "shard", "segment", "first_key"))
                place = EliasFano(n, r["n_ids"].as_py(), raw["ends_low"], raw["ends_high"], raw["ends_select"])
                known = EliasFano(n - nulls, r["keys_last"].as_py(), raw["keys_low"], raw["keys_high"], raw["keys_select"])
                start = 0
                for a in range(0, n, READ_DOCS):
                    b = min(a + READ_DOCS, n)
                    ends = place.select(a, b).astype(np.int64)
                    bounds = np.concatenate(([start], ends))
                    ids = memoryview(np.frombuffer(raw["ids"], f"<u{width}", bounds[-1] - start, start * width).astype("<u4")).cast("B")
                    bytes_at = (4 * (bounds - start)).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(bytes_at, bytes_at[1:], strict=False)]
                    keys = known.select(max(a - nulls, 0), max(b - nulls, 0)).astype(np.int64) + first
                    columns = [np.full(b - a, shard, np.int32), np.full(b - a, segment, np.int32), pa.concat_arrays([pa.nulls(b - a - len(keys), pa.int64()), pa.array(keys)]), bounds[:-1], np.diff(bounds), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
                    start = int(ends[-1])

    counts = segments.select("shard", "segment", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("own"))
    shards = shards.select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    bases = counts.select("shard", "segment", inner.alias("inner")).join(shards, "shard")
    rows = segments.mapInArrow(run, "shard int, segment int, k long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["shard", "segment"]).select(F.col("k").alias(key), (F.col("base") + F.col("inner") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
