"""The corpus pipeline: from raw documents to packed windows of token ids.

Five stages in order; each takes the documents that its predecessor kept and all but the last return the columns
of documents. Results between stages are written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import bound_batches, collect_garbage, documents, stored
from seriesloom.llm.exact_dedup import drop_duplicates
from seriesloom.llm.mixing import mixed_texts
from seriesloom.llm.neardup import drop_near_duplicates
from seriesloom.llm.packing import pack
from seriesloom.llm.toxicity import keep_clean, toxicity_chain


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, by the chain fitted on the labels table, is below one half."""
    collect_garbage(spark)
    return keep_clean(docs, toxicity_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id."""
    collect_garbage(spark)
    return drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without an id stay."""
    collect_garbage(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: stretches of documents, as often as the mix of sources takes them, in the order of its shards."""
    collect_garbage(spark)
    return mixed_texts(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 1024 token ids."""
    collect_garbage(spark)
    bound_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack_windows)]

#: Tokenizers and fitted models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
