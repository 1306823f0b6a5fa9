"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import best_fit_pack
from .common import documents, shared_path
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .id_files import document_table, read_id_files, write_id_files
from .html import visible_text
from .language import language_id
from .lexical import ranked_search
from .matroska import digest, store
from .mixing import mixed_words
from .neardup import near_duplicates
from .packing import pack
from .token_counts import token_counts
from .toxicity import toxicity


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "id-files")
    write_id_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return document_table(read_id_files(spark, path))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = F.col("label").cast("long"), F.col("embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite)
    rows = rows.select("vec_id", shifted.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html, op2_packing, op3_mixing, op4_minhash, op5_token_counts, op6_toxicity, op7_matroska, op8_exact_dedup, op9_id_files, op10_language, op11_hard_negatives, op12_ranked_search, op13_best_fit)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256
        FROM n JOIN g USING (t)""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                   FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank,
               s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5""",
    "op12_ranked_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents),
             tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
             z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n), m AS (SELECT doc_id, 50 + (50 * n * docs) // words AS m FROM n, z),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z GROUP BY term, docs),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark),
             s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
