"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tokens import CHUNK_BYTES, chunks, cut_long, encoder


def lengths(texts: pa.Array, vocabulary: str) -> np.ndarray:
    """Token counts of a batch. The encoder takes the batch in runs of about equal bytes; a text longer than a
    run is first cut at spaces between words, which no token crosses, and the counts of its parts are added."""
    enc = encoder(vocabulary)
    sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros(len(texts), np.int64)
    short = sizes <= CHUNK_BYTES
    out[short] = enc.count(texts.filter(pa.array(short)))
    for i in np.flatnonzero(~short):
        whole = texts[int(i)].as_py()
        safe = not pc.match_substring_regex(pa.array([whole]), enc.hard)[0].as_py()
        parts = cut_long(whole, CHUNK_BYTES // 4, enc.leading_space) if safe else [whole]
        out[i] = sum(int(enc.count(pa.array([p]))[0]) for p in parts)
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, n_bytes (UTF-8), n_tokens as the vocabulary's own library gives them, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys stay. One narrow stage without
    a shuffle; other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            n = lengths(texts, vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)
