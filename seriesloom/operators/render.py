"""Sentences from claims, in built-in string functions; wording varies by a stable hash of series and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text, short_time

TREND_ZH = {"up": "上升", "down": "下降", "flat": "平稳", "up_then_down": "先升后降", "down_then_up": "先降后升"}
LEVEL_ZH = {"low": "较低", "medium": "中等", "high": "较高"}


def _words(column: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column), column)


def _choice(options: list[str], *parts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(*parts), F.lit(len(options))) + 1).cast("int"))


def _kept_phase(r: Column, n: Column) -> Column:
    step = F.greatest(F.floor((n - 4) / 2), F.lit(1))
    return (n <= 5) | (r < 2) | (r >= n - 2) | ((r - 2) % step == 0)


def thinned_phases(phases: DataFrame) -> DataFrame:
    """More than five phases: the first two, the last two, and of the m between every max(1, m // 2)-th."""
    w = Window.partitionBy("series_key", "w_start")
    r, n = F.row_number().over(w.orderBy("phase")) - 1, F.count("*").over(w)
    placed = phases.withColumns({"_r": r, "_n": n})
    return placed.where(_kept_phase(F.col("_r"), F.col("_n"))).drop("_r", "_n")


def _form(label: Column, start_v: Column, end_v: Column, min_v: Column, max_v: Column, before: Column) -> Column:
    """dip or spike if a phase leaves the span of its ends by more than 1.5 spans and 5 % of its start (dip first),
    else continue if its label is that of the phase before, else plain. Without both ends it is no dip or spike."""
    bound = F.when(start_v.isNotNull() & end_v.isNotNull(), F.greatest(1.5 * F.abs(end_v - start_v), 0.05 * F.abs(start_v)))
    dip, spike = min_v < F.least(start_v, end_v) - bound, max_v > F.greatest(start_v, end_v) + bound
    return F.when(dip, "dip").when(spike, "spike").when(before == label, "continue").otherwise("plain")


def phase_forms(phases: DataFrame) -> DataFrame:
    """Adds form (dip, spike, continue, plain): how a phase is told after the one before it."""
    before = F.lag("label").over(Window.partitionBy("series_key", "w_start").orderBy("phase"))
    return phases.withColumn("_b", before).withColumn("form", _form(*map(F.col, ("label", "start_v", "end_v", "min_v", "max_v", "_b")))).drop("_b")


def told_extremes(claims: Column, most: int = 3) -> Column:
    """The first `most` peaks, then the first `most` valleys (claims come strongest first), each group in order of time."""
    by_time = lambda a, b: F.coalesce(a["idx"], F.lit(0)) - F.coalesce(b["idx"], F.lit(0))
    of = lambda kind: F.array_sort(F.slice(F.filter(claims, lambda c: c["type"] == kind), 1, most), by_time)
    return F.concat(of("peak"), of("valley"))


def render_zh(claims: Column, target: str, series_key: Column, w_start: Column, times: Column) -> Column:
    """A Chinese paragraph: span, trend and change, phases by their form (see phase_forms()), ramps,
    extremes in order of time, relations, seasonality, volatility. A flat phase that continues is told with its range."""
    of = lambda kind: F.filter(claims, lambda c: c["type"] == kind)
    one = lambda kind: F.try_element_at(of(kind), F.lit(1))["data"]
    trend, net, vol, season = one("global_trend_label"), one("global_net_change"), one("volatility_most_segment"), one("seasonality")
    label = _words(F.coalesce(trend["label_final"], trend["label"]), TREND_ZH)
    begin, end = F.element_at(times, 1), F.element_at(times, -1)
    intro = F.concat(F.lit(f"{target}在"), begin, F.lit("至"), short_time(end, begin), F.lit("期间"))
    overview = F.concat(_choice(["整体呈", "总体表现为", "大体上呈"], series_key, w_start, F.lit("o")), label, F.lit("走势，由"), number_text(net["start_v"]), F.lit("变为"), number_text(net["end_v"]), F.lit("（"), number_text(net["delta_pct"]), F.lit("%）。"))
    every = of("phase")
    n = F.size(every)
    shown = F.filter(every, lambda c, i: _kept_phase(i, n))

    def told(c: Column, i: Column) -> Column:
        data = c["data"]
        form = _form(*[data[x] for x in ("label", "start_v", "end_v", "min_v", "max_v")], F.get(shown, i - 1)["data"]["label"])
        span = F.concat(F.lit("，区间为"), number_text(data["min_v"]), F.lit("至"), number_text(data["max_v"]))
        extra = F.when((form == "continue") & (data["label"] == "flat"), span).when(form == "dip", F.concat(F.lit("，一度下探至"), number_text(data["min_v"]))).when(form == "spike", F.concat(F.lit("，一度冲高至"), number_text(data["max_v"]))).otherwise("")
        return F.concat(c["t_start"], F.lit("至"), short_time(c["t_end"], c["t_start"]), F.when(form == "continue", "延续").otherwise(""), _words(data["label"], TREND_ZH), F.lit("（"), number_text(data["delta_pct"]), F.lit("%）"), extra)

    phase = F.transform(shown, told)
    phases = F.when(n > 0, F.concat(_choice(["分阶段看，", "其中，"], series_key, w_start, F.lit("p")), F.array_join(phase, "；"), F.lit("。")))
    ramp = F.transform(of("ramp"), lambda c: F.concat(c["t_start"], F.lit("至"), short_time(c["t_end"], c["t_start"]), F.when(c["data"]["kind"] == "ramp_up", "快速抬升").otherwise("快速回落"), F.lit("（"), number_text(c["data"]["delta_pct"]), F.lit("%）")))
    ramps = F.when(F.size(ramp) > 0, F.concat(F.lit("幅度最大的变化为"), F.array_join(ramp, "；"), F.lit("。")))
    extreme = F.transform(told_extremes(claims), lambda c: F.concat(F.coalesce(c["t_idx"], F.lit("")), F.when(c["type"] == "peak", "出现峰值").otherwise("出现谷值"), number_text(c["data"]["value"])))
    extremes = F.when(F.size(extreme) > 0, F.concat(F.array_join(extreme, "，"), F.lit("。")))
    relation = F.transform(of("lagged_corr"), lambda c: F.concat(F.lit("与"), c["data"]["var"], F.when(c["data"]["corr"] > 0, "正相关").otherwise("负相关"), F.lit("（滞后"), c["data"]["lag"].cast("string"), F.lit("步）")))
    relations = F.when(F.size(relation) > 0, F.concat(F.array_join(relation, "，"), F.lit("。")))
    seasonal = F.when(season["has"], F.concat(F.lit("存在约"), season["period"].cast("string"), F.lit("步的周期。"))).otherwise("未见明显周期。")
    ending = F.concat(_choice(["波动性", "整体波动"], series_key, w_start, F.lit("v")), _words(vol["label"], LEVEL_ZH), F.lit("。"))
    return F.concat_ws("", intro, overview, phases, ramps, extremes, relations, seasonal, ending)


def summary_en(claims: Column) -> Column:
    """Two English sentences from the trend, net change, volatility and seasonality claims."""
    one = lambda kind: F.try_element_at(F.filter(claims, lambda c: c["type"] == kind), F.lit(1))["data"]
    trend, net, vol, season = one("global_trend_label"), one("global_net_change"), one("volatility_most_segment"), one("seasonality")
    first = F.concat(F.lit("The series moves "), F.regexp_replace(F.coalesce(trend["label_final"], trend["label"]), "_", " "), F.lit(", from "), number_text(net["start_v"]), F.lit(" to "), number_text(net["end_v"]), F.lit(" ("), number_text(net["delta_pct"]), F.lit("%)."))
    second = F.concat(F.lit("Its step volatility is "), vol["label"], F.when(season["has"], F.concat(F.lit(", with a period of about "), season["period"].cast("string"), F.lit(" steps."))).otherwise(", without a clear period."))
    return F.concat_ws(" ", first, second)
