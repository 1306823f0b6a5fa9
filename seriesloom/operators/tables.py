"""Tables for training: facts, fine-tuning rows, flat captions and local events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sample_id, single_spaces, strip_numbers
from .clean import preferred
from .windows import patch_span

#: Prompts by style and language; callers may pass their own table (style, lang, prompt).
PROMPTS = [
    ("caption_only", "en", "Describe the given time series in 2-4 objective sentences: trend, volatility, and peaks, valleys or seasonality where present. Give the description only."),
    ("facts_only", "en", "Give the facts of the given time series as strict JSON with the single key facts: trend, delta_pct, peak, valley, volatility, seasonality."),
    ("json_caption", "en", "Give strict JSON with the keys facts and caption for the given time series; the caption has 2-4 sentences that agree with the facts."),
    ("caption_only", "zh", "请用2-4句中文客观描述给定的时间序列：整体趋势、波动性，以及可能存在的峰值、谷值与季节性。只输出描述。"),
    ("facts_only", "zh", "请以严格JSON输出给定时间序列的事实，唯一字段为facts：trend、delta_pct、peak、valley、volatility、seasonality。"),
    ("json_caption", "zh", "请以严格JSON输出给定时间序列的facts与caption两个字段；caption为2-4句中文，须与facts一致。"),
]


def wanted_events(local: Column, types: list[str] | None = None, text: str = "text") -> Column:
    """Local events with start, end and a text, of the given types."""
    ok = lambda e: e["start"].isNotNull() & e["end"].isNotNull() & (F.length(F.trim(e[text])) > 0)
    return F.filter(local, lambda e: ok(e) & (e["type"].isin(types) if types else F.lit(True)))


def passed(records: DataFrame) -> DataFrame:
    """Records whose claim check passes."""
    return records.where(F.coalesce(F.col("claim_check.pass"), F.lit(False)))


def captioned(records: DataFrame) -> DataFrame:
    """Records that have a first description."""
    return records.where(F.length(F.trim(F.try_element_at("descriptions", F.lit(1)))) > 0)


def facts(claims: Column, volatility: Column) -> Column:
    """The facts of a record from its claims; a field is null if no claim tells it. Of several peaks the highest
    counts, of several valleys the lowest, the first on ties."""
    first = lambda kind: F.try_element_at(F.filter(claims, lambda c: c["type"] == kind), F.lit(1))["data"]
    trend, net, season = first("global_trend_label"), first("global_net_change"), first("seasonality")

    def pick(kind: str, sign: int) -> Column:
        found = F.filter(claims, lambda c: (c["type"] == kind) & c["data"]["value"].isNotNull())
        keyed = F.transform(found, lambda c, i: F.struct((sign * c["data"]["value"]).alias("k"), (-i).alias("i"), c["idx"].alias("idx"), c["data"]["value"].alias("value")))
        top = F.array_max(keyed)
        return F.when(top.isNotNull(), F.struct(top["idx"].alias("idx"), top["value"].alias("value")))

    delta = net["delta_pct"]
    sign = F.when(delta > 0, "pos").when(delta < 0, "neg").when(delta == 0, "zero")
    return F.struct(
        F.coalesce(trend["label_final"], trend["label"], trend["label_raw"]).alias("trend"), delta.alias("delta_pct"), sign.alias("net_change_sign"), pick("peak", 1).alias("peak"), pick("valley", -1).alias("valley"),
        F.when(season.isNotNull(), F.struct(F.coalesce(season["has"], F.lit(False)).alias("has"), season["period"].alias("period"))).alias("seasonality"), volatility.alias("volatility"),
    )


def fact_caption(f: Column, lang: str = "en") -> Column:
    """A caption made of the facts alone. The sentence formats are fixed values."""
    zh = lang == "zh"
    trend, vol, delta = F.coalesce(f["trend"], F.lit("unknown")), F.coalesce(f["volatility"], F.lit("unknown")), f["delta_pct"]
    words = ("上升", "下降", "基本不变") if zh else ("increase", "decrease", "little net change")
    sign = F.when(delta > 0, words[0]).when(delta < 0, words[1]).otherwise(words[2])
    formats = (
        ("整体趋势为%s，净变化%s，相对变化约%.2f%%。", "整体趋势为%s。", "序列在索引%d附近出现峰值（约%.3f）。", "序列在索引%d附近出现谷值（约%.3f）。", "存在季节性，周期约为%s。", "未检测到明显季节性。", "整体波动性为%s。")
        if zh
        else ("Overall trend is %s with a net %s of about %.2f%%.", "Overall trend is %s.", "A peak occurs around index %d (value ≈ %.3f).", "A valley occurs around index %d (value ≈ %.3f).", "Seasonality is detected with period ≈ %s.", "No clear seasonality is detected.", "Overall volatility is %s.")
    )
    has = f["seasonality"]["has"]
    parts = [
        F.when(delta.isNotNull(), F.format_string(formats[0], trend, sign, delta)).otherwise(F.format_string(formats[1], trend)),
        F.when(f["peak"]["idx"].isNotNull(), F.format_string(formats[2], f["peak"]["idx"], f["peak"]["value"])),
        F.when(f["valley"]["idx"].isNotNull(), F.format_string(formats[3], f["valley"]["idx"], f["valley"]["value"])),
        F.when(has, F.format_string(formats[4], f["seasonality"]["period"].cast("string"))).when(has.isNotNull(), formats[5]),
        F.format_string(formats[6], vol),
    ]
    return F.concat_ws("" if zh else " ", *parts)


def natural_caption(records: DataFrame, lang: str) -> Column:
    d = F.col("dense_captions")
    return preferred(d["global"][lang], d["domain_integrated"][lang], F.try_element_at("descriptions", F.lit(1)), F.try_element_at("descriptions", F.lit(2)))


def build_sft(records: DataFrame, styles: tuple[str, ...] = ("caption_only", "facts_only", "json_caption"), lang: str = "en", both: bool = False, template: bool = False, keep_meta: bool = False) -> DataFrame:
    """Fine-tuning rows: id, values, prompt, output, facts (and meta), one for each record, style and caption.

    Styles with a caption use the natural one, or the template without one or on demand; `both` gives both.
    """
    spark = records.sparkSession
    prompts = spark.createDataFrame([p for p in PROMPTS if p[1] == lang], "style string, lang string, prompt string").drop("lang")
    base = records.withColumn("facts", facts(F.col("claims"), F.col("features.volatility"))).withColumn("natural", natural_caption(records, lang))
    base = base.withColumn("made", fact_caption(F.col("facts"), lang)).withColumn("sid", sample_id(F.col("dataset"), F.col("task"), F.col("series_key")))
    use_both = F.lit(both and not template) & F.col("natural").isNotNull()
    single = F.struct(F.lit("single").alias("tag"), (F.col("made") if template else F.coalesce("natural", "made")).alias("caption"))
    pair = F.array(F.struct(F.lit("natural").alias("tag"), F.col("natural").alias("caption")), F.struct(F.lit("template").alias("tag"), F.col("made").alias("caption")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.col("made").alias("caption")))
    rows = base.withColumn("style", F.explode(F.array(*map(F.lit, styles))))
    variants = F.when(F.col("style").isin("facts_only", "bullet"), none).when(use_both, pair).otherwise(F.array(single))
    rows = rows.withColumn("v", F.explode(variants)).withColumn("ask", F.when(F.col("style") == "bullet", "json_caption").otherwise(F.col("style")))
    output = F.when(F.col("style") == "facts_only", F.to_json(F.struct("facts"))).when(F.col("style") == "json_caption", F.to_json(F.struct("facts", F.col("v.caption").alias("caption")))).otherwise(F.col("v.caption"))
    name = F.concat_ws("_", F.concat(F.col("sid"), F.lit("::"), F.col("style")), F.lit(lang), F.col("v.tag"))
    meta = [F.struct("dataset", "task", "series_key", "label", "claim_check", "features").alias("meta")] if keep_meta else []
    joined = rows.join(F.broadcast(prompts.withColumnRenamed("style", "ask")), "ask", "left")  # at most a row a style
    return joined.select(name.alias("id"), F.col("timeseries").alias("values"), "prompt", output.alias("output"), "facts", *meta)


def sft_counts(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Records read, fine-tuning rows made of them, and records that the claim check skips, as counted."""
    skipped = (~F.coalesce(F.col("claim_check.pass"), F.lit(False))).cast("int")
    each = records.select(F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), skipped.alias("n_skipped")).union(rows.select(F.lit(0), F.lit(1), F.lit(0)))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in each.columns])


def flat_captions(samples: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """sample_id, group_key, position, text: at most `most` captions of each sample, chosen by hash."""
    each = samples.select("sample_id", "group_key", F.posexplode("captions").alias("position", "text"))
    order = Window.partitionBy("sample_id").orderBy(F.xxhash64("sample_id", "position", F.lit(seed)), "position")
    return each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def flat_events(samples: DataFrame, size: int, most: int, seed: int = 0) -> DataFrame:
    """Local events (array local of start, end, type, text) as patch spans: sample_id, position, type, text, ps, pe."""
    each = samples.select("sample_id", "n", F.posexplode("local").alias("position", "e"))
    order = Window.partitionBy("sample_id").orderBy(F.xxhash64("sample_id", "position", F.lit(seed)), "position")
    kept = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    ps, pe = patch_span(F.col("e.start"), F.col("e.end"), F.col("n"), size)
    return kept.select("sample_id", "position", "e.type", "e.text", ps.alias("ps"), pe.alias("pe"))


def local_events(records: DataFrame, lang: str = "en", types: list[str] | None = None, bare: bool = False) -> DataFrame:
    """Local events of records in one language, the other one where it is blank: series_key, start, end, type, text."""
    own, other = f"description_{lang}", "description_zh" if lang == "en" else "description_en"
    each = records.select("series_key", F.explode("dense_captions.local").alias("e"))
    text = preferred(F.col("e")[own], F.col("e")[other])
    text = single_spaces(strip_numbers(text) if bare else text)
    out = each.select("series_key", "e.start", "e.end", "e.type", text.alias("text")).where("start is not null and end is not null and length(text) > 0")
    return out.where(F.col("type").isin(types)) if types else out


def combine_series_text(parts: DataFrame) -> DataFrame:
    """row, position, text as one text a row: parts in order of position, one a line; blank parts are left out."""
    kept = parts.where(F.length(F.trim("text")) > 0)
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p"))
    return lists.select("row", F.array_join(F.col("p.text"), "\n").alias("text"))


def best_extreme(events: DataFrame, keys: list[str]) -> DataFrame:
    """The highest peak and the lowest valley of each group, the first on ties."""
    score = F.when(F.col("kind") == "peak", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc(score), "i")
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
