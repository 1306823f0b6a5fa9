"""Caption quality: parsing of model text, factual metrics, ROUGE-L and corpus BLEU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import clipped_grams

ANSWER = "facts struct<trend: string, delta_pct: double, net_change_sign: string, peak: struct<idx: double, value: double>, valley: struct<idx: double, value: double>, seasonality: struct<has: boolean, period: double>, volatility: string>, caption string"


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both in this order."""
    begin, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((begin > 0) & (F.instr(text, "}") > 0) & (end > begin), F.substring(text, begin, end - begin + 1))


def parse_answer(rows: DataFrame, text: str = "hyp") -> DataFrame:
    """Adds facts (null if there are none) and caption (the text itself, trimmed, if none can be read)."""
    parsed = F.from_json(json_part(F.col(text)), ANSWER)
    return rows.withColumn("_p", parsed).withColumns({"facts": F.col("_p.facts"), "caption": F.trim(F.coalesce(F.col("_p.caption"), F.col(text)))}).drop("_p")


def factual_metrics(rows: DataFrame, truth: str = "gt", said: str = "pred") -> DataFrame:
    """Long form id, metric, value: 1 or 0 for words that agree, absolute errors of numbers; none where either side
    lacks the field."""
    g, p = (lambda path: F.col(f"{truth}.{path}")), (lambda path: F.col(f"{said}.{path}"))
    words = {"fact_acc/trend": "trend", "fact_acc/volatility": "volatility", "fact_acc/net_change_sign": "net_change_sign", "fact_acc/seasonality_has": "seasonality.has"}
    numbers = {"fact_mae/delta_pct": "delta_pct", "fact_mae/seasonality_period": "seasonality.period", "fact_mae/peak_idx": "peak.idx", "fact_mae/peak_value": "peak.value", "fact_mae/valley_idx": "valley.idx", "fact_mae/valley_value": "valley.value"}
    cells = [F.struct(F.lit(m).alias("metric"), (g(c) == p(c)).cast("double").alias("value")) for m, c in words.items()]
    cells += [F.struct(F.lit(m).alias("metric"), F.abs(g(c) - p(c)).cast("double").alias("value")) for m, c in numbers.items()]
    return rows.select("id", F.inline(F.array(*cells))).where("value is not null")


def metric_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("rows"))


def bleu_tokens(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]"), F.lit(0))


def bleu_counts(pairs: DataFrame) -> DataFrame:
    """Per order 1..4: matched and total n-grams of the hypotheses, clipped pair by pair. pairs: id, ref, hyp.

    The clipped matches of a pair are a multiset intersection within its row; only sums are shuffled.
    """
    counts = pairs.select(clipped_grams(bleu_tokens(F.col("ref")), bleu_tokens(F.col("hyp"))).alias("c"))
    sums = counts.agg(*[F.sum(F.col(f"c.{side}_{n}")).alias(f"{side}_{n}") for side in ("matched", "total") for n in range(1, 5)])
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"matched_{n}").alias("matched"), F.col(f"total_{n}").alias("total")) for n in range(1, 5)])
    return sums.select(F.inline(rows)).where("total > 0")


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """One row: bleu (0 to 100, no smoothing), brevity penalty and lengths."""
    sizes = pairs.agg(F.sum(F.size(bleu_tokens(F.col("ref")))).alias("ref_len"), F.sum(F.size(bleu_tokens(F.col("hyp")))).alias("hyp_len"))
    log = F.sum(F.when(F.col("matched") > 0, F.log(F.col("matched") / F.col("total")))) / 4
    score = bleu_counts(pairs).agg(log.alias("log"), F.count_if(F.col("matched") > 0).alias("orders")).withColumn("_k", F.lit(1))
    joined = sizes.withColumn("_k", F.lit(1)).join(score, "_k")  # one row each
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest(F.col("hyp_len"), F.lit(1))))
    return joined.select(F.when(F.col("orders") == 4, 100 * penalty * F.exp("log")).otherwise(0.0).alias("bleu"), penalty.alias("penalty"), "ref_len", "hyp_len")
