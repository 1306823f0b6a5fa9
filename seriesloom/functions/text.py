"""Text and scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of index words, numbers and punctuation.
INDEX_WORDS = r"(?i)(time\s*\d+)|(index\s*\d+)|(索引\s*\d+)|(时间点\s*\d+)"
NUMBER = r"[-+]?\d+(\.\d+)?%?"
PUNCTUATION = r"\s*([,.;:，。；：])\s*"
CLASS_LINES = (r"(?im)^\s*class\s*(\d+)\s*[:=\-]\s*(.+?)\s*$", r"(?im)^\s*label\s*(\d+)\s*[:=\-]\s*(.+?)\s*$", r"(?im)^\s*(\d+)\s*[:=\-]\s*(.+?)\s*$")
BOILERPLATE = "train size|test size|time series length|missing value"


def strip_numbers(text: Column) -> Column:
    """Without numbers, percentages and index words; single spaces, tidy punctuation."""
    bare = F.regexp_replace(F.regexp_replace(text, INDEX_WORDS, ""), NUMBER, "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), PUNCTUATION, "$1 "))


def single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def group_key(dataset: Column, task: Column, series_key: Column, label_json: Column, positive: str = "instance") -> Column:
    """Key that positives share: the series, or the label (its class if it is an object; none if it is null)."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if positive == "label":
        label = F.coalesce(F.get_json_object(label_json, "$.class"), label_json, F.lit("none"))
        return F.concat_ws("|", empty(dataset), empty(task), F.concat(F.lit("label:"), label))
    return F.concat_ws("|", empty(dataset), empty(task), F.concat(F.lit("series:"), empty(series_key)))


def sample_id(dataset: Column, task: Column, series_key: Column, fallback: Column | None = None) -> Column:
    known = lambda *c: F.coalesce(*[F.nullif(x.cast("string"), F.lit("")) for x in c if x is not None], F.lit("unknown"))
    return F.concat_ws(":", known(dataset), known(task), known(series_key, fallback))


def class_map(readme: Column) -> Column:
    """Entries (id, text) of class lines. Short and boilerplate texts are left out, long ones cut at 200; of several
    lines for a class the last one of the last pattern counts (take the greatest `place`)."""
    def entries(rank: int, pattern: str) -> Column:
        ids, texts = F.regexp_extract_all(readme, F.lit(pattern), F.lit(1)), F.regexp_extract_all(readme, F.lit(pattern), F.lit(2))
        return F.transform(F.arrays_zip(ids.alias("id"), texts.alias("text")), lambda x, i: F.struct((F.lit(rank * 1_000_000) + i).alias("place"), F.trim(x["id"]).alias("id"), F.trim(x["text"]).alias("text")))

    found = [entries(rank, pattern) for rank, pattern in enumerate(CLASS_LINES)]
    kept = F.filter(F.concat(*found), lambda x: (F.length(x["text"]) >= 2) & ~F.lower(x["text"]).rlike(BOILERPLATE))
    return F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["id"].alias("id"), F.when(F.length(x["text"]) > 200, F.concat(F.substring(x["text"], 1, 200), F.lit("..."))).otherwise(x["text"]).alias("text")))


def first_lines(text: Column, count: int = 12, ending: str = r"\r?\n") -> Column:
    """The first lines that are not blank, without the spaces (of any width) around them."""
    bare = F.transform(F.split(text, ending), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+$", ""))
    lines = F.filter(bare, lambda x: x != "")
    return F.array_join(F.slice(lines, 1, count), "\n")


def number_text(value: Column, digits: int = 2) -> Column:
    """Whole numbers from 1000 without decimals, others with fixed ones; NaN, infinity and null are empty."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    whole = (F.abs(value) >= 1000) & (F.abs(value - F.round(value)) < 1e-6)
    return F.when(odd, "").when(whole, value.cast("long").cast("string")).otherwise(F.format_string(f"%.{digits}f", value))


def short_time(time: Column, before: Column) -> Column:
    """Only the clock time if the day is that of the time before."""
    same = (F.length(time) > 10) & (F.length(before) > 10) & (F.substring(time, 1, 10) == F.substring(before, 1, 10))
    return F.when(time.isNull(), "").when(same, F.trim(F.substring(time, 12, 1000))).otherwise(time)


def series_text(values: Column, style: str = "plain", marked: Column | None = None) -> Column:
    """One value a line with four decimals; style `timed` puts `t=i: ` before, `marked` a star after one place."""
    def line(x: Column, i: Column) -> Column:
        text = F.format_string("%.4f", x)
        text = F.concat(F.lit("t="), i.cast("string"), F.lit(": "), text) if style == "timed" else text
        return text if marked is None else F.when(i == marked, F.concat(text, F.lit(" *"))).otherwise(text)

    return F.array_join(F.transform(values, line), "\n")


def stable_seed(*parts: Column) -> Column:
    """The first 32 bits of the SHA-256 of the parts joined by bars."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")


def guard_text(base: Column, text: Column, context: Column, columns: Column) -> Column:
    """`text` if all its numbers occur in base or context and all its column-like words are columns; else base."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9_\.]*\b"), F.lit(0))
    odd = F.filter(words, lambda w: w.startswith("MT_") | w.contains("_") | ((w == F.upper(w)) & (F.length(w) <= 12)))
    sound = (F.size(F.array_except(numbers(text), F.concat(numbers(base), numbers(context)))) == 0) & (F.size(F.array_except(odd, columns)) == 0)
    return F.when(sound, text).otherwise(base)


# What metric names by prefix mean, tried in order.
CLOUD_METRICS = (
    ("ec2_cpu_utilization", "EC2 CPU 使用率（CloudWatch）"),
    ("ec2_disk_write_bytes", "EC2 磁盘写入字节数（CloudWatch）"),
    ("ec2_disk_read_bytes", "EC2 磁盘读取字节数（CloudWatch）"),
    ("ec2_network_in", "EC2 网络流入字节数（CloudWatch）"),
    ("ec2_network_out", "EC2 网络流出字节数（CloudWatch）"),
    ("elb_request_count", "ELB 请求量（CloudWatch）"),
    ("rds_cpu_utilization", "RDS CPU 使用率（CloudWatch）"),
    ("grok_asg_anomaly", "Auto Scaling Group（ASG）相关异常示例指标"),
)


def key_meaning(series_key: Column) -> Column:
    """What a metric series measures, from `group/stem.csv`: by prefix or pattern within known groups, else generic."""
    group, stem = F.regexp_extract(series_key, r"^([^/]*)/", 1), F.regexp_extract(series_key, r"([^/]+?)(?:\.csv)?$", 1)
    cloud = F.concat(F.lit("AWS CloudWatch 指标："), stem)
    for prefix, meaning in reversed(CLOUD_METRICS):
        cloud = F.when(stem.startswith(prefix), meaning).otherwise(cloud)
    exchange = F.regexp_extract(stem, r"^exchange-(\d+)_cp[cm]_results", 1)
    ads = F.when(stem.rlike(r"^exchange-\d+_cpc_results"), F.concat(F.lit("在线广告交换场景 "), exchange, F.lit("：CPC（cost per click）")))
    ads = ads.when(stem.rlike(r"^exchange-\d+_cpm_results"), F.concat(F.lit("在线广告交换场景 "), exchange, F.lit("：CPM（cost per mille）"))).otherwise(F.concat(F.lit("在线广告指标："), stem))
    tweets = F.when(stem.startswith("Twitter_volume_"), F.concat(F.lit("Twitter 提及量："), F.regexp_replace(stem, "^Twitter_volume_", ""), F.lit("（每 5 分钟一个点）"))).otherwise(F.concat(F.lit("Twitter 指标："), stem))
    return F.when(group == "realAWSCloudwatch", cloud).when(group == "realAdExchange", ads).when(group == "realTweets", tweets).otherwise(F.concat(F.lit("NAB 指标："), group, F.lit("/"), stem))


RESPONSE = "global struct<zh: string, en: string>, domain struct<zh: string, en: string>, local array<struct<segment_id: int, description: struct<zh: string, en: string>>>"


def parse_response(raw: Column) -> Column:
    """A stored caption response: without code fences, cut to its outer braces, parsed; null without a global text."""
    bare = F.regexp_replace(raw, "```[a-zA-Z]*", "")
    begin, end = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    body = F.when((begin > 0) & (F.instr(bare, "}") > 0) & (end > begin), F.substring(bare, begin, end - begin + 1))
    parsed = F.from_json(body, RESPONSE)
    return F.when(parsed["global"]["zh"].isNotNull() & parsed["global"]["en"].isNotNull(), parsed)
