"""Per-window features of a series: level, spread, trend, volatility, labels. Windows as in operators.windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels
from .windows import KEY, equal_segment

EPS = 1e-8


def per_window() -> WindowSpec:
    """The rows of a window."""
    return Window.partitionBy(*KEY)


def mean_of(value: str = "value") -> Column:
    return F.avg(value).over(per_window())


def std_of(value: str = "value") -> Column:
    return F.stddev_pop(value).over(per_window())


def z_score(value: str = "value") -> Column:
    """Distance from the window's mean in standard deviations; zero where there is no spread."""
    return F.when(std_of(value) < EPS, F.lit(0.0)).otherwise((F.col(value) - mean_of(value)) / std_of(value))


def robust_scale(value: str = "value") -> Column:
    return F.greatest(F.abs(mean_of(value)), std_of(value), F.lit(EPS))


def change_pct(a: Column, b: Column, scale: Column) -> Column:
    return (b - a) / scale * 100.0


def with_z(windows: DataFrame) -> DataFrame:
    """Adds z, mean, std and scale of the window."""
    return windows.withColumns({"z": z_score(), "mean": mean_of(), "std": std_of(), "scale": robust_scale()})


def detrend(windows: DataFrame) -> DataFrame:
    """Adds residual: the value less the window's least-squares line; with under three points, less the mean."""
    slope, level = F.regr_slope("value", "i").over(per_window()), F.regr_intercept("value", "i").over(per_window())
    line = F.when(F.col("n") < 3, mean_of()).otherwise(F.coalesce(slope, F.lit(0.0)) * F.col("i") + F.coalesce(level, mean_of()))
    return windows.withColumn("residual", F.col("value") - line)


def trend_segments(windows: DataFrame, k: int = 3, threshold: float = 0.03) -> DataFrame:
    """Per equal segment: seg, start, end, slope_z (slope in deviations a step) and label up / down / flat."""
    part = windows.withColumn("std", std_of()).withColumn("seg", equal_segment(F.col("i"), F.col("n"), k))
    fits = part.groupBy(*KEY, "seg").agg(F.regr_slope("value", "i").alias("slope"), F.first("std").alias("std"), F.min("i").alias("start"), F.max("i").alias("end"))
    slope = F.when(F.col("std") < EPS, F.lit(0.0)).otherwise(F.coalesce(F.col("slope") / F.col("std"), F.lit(0.0)))
    label = F.when(slope > threshold, "up").when(slope < -threshold, "down").otherwise("flat")
    return fits.select(*KEY, "seg", "start", "end", slope.alias("slope_z"), label.alias("label"))


def global_trend(segments: DataFrame, k: int = 3, threshold: float = 0.03) -> DataFrame:
    """One label a window: up_then_down or down_then_up by the first and last segment, else by the mean slope."""
    agg = segments.groupBy(*KEY).agg(F.max(F.when(F.col("seg") == 0, F.col("label"))).alias("first"), F.max_by("label", "seg").alias("last"), (F.sum("slope_z") / k).alias("avg_slope"))
    first, last, avg = F.col("first"), F.col("last"), F.col("avg_slope")
    label = F.when((first == "up") & (last == "down"), "up_then_down").when((first == "down") & (last == "up"), "down_then_up").when(avg > threshold, "up").when(avg < -threshold, "down").otherwise("flat")
    return agg.select(*KEY, "avg_slope", label.alias("trend"))


def net_change(windows: DataFrame) -> DataFrame:
    """start_v, end_v and delta_pct from the first to the last point, in percent of the robust scale."""
    agg = windows.groupBy(*KEY).agg(F.min_by("value", "i").alias("start_v"), F.max_by("value", "i").alias("end_v"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    scale = F.greatest(F.abs("mean"), F.col("std"), F.lit(EPS))
    return agg.select(*KEY, "start_v", "end_v", change_pct(F.col("start_v"), F.col("end_v"), scale).alias("delta_pct"))


def volatility(windows: DataFrame, k: int = 3) -> DataFrame:
    """Standard deviation over range, of z in each equal segment, and the first most volatile segment."""
    part = with_z(windows).withColumn("seg", equal_segment(F.col("i"), F.col("n"), k))
    span = F.max("value").over(per_window()) - F.min("value").over(per_window())
    part = part.withColumn("overall", F.col("std") / F.when(span > 0, span).otherwise(F.lit(1.0)))
    each = part.groupBy(*KEY, "seg").agg(F.stddev_pop("z").alias("seg_std"), F.first("overall").alias("overall"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("seg_std"), "seg"))
    ranked = each.withColumn("rank", rank)
    stds = [F.coalesce(F.max(F.when(F.col("seg") == s, F.col("seg_std"))), F.lit(0.0)).alias(f"std_{s}") for s in range(k)]
    return ranked.groupBy(*KEY).agg(F.first("overall").alias("overall_std"), *stds, F.max(F.when(F.col("rank") == 1, F.col("seg"))).alias("most"))


def volatility_label(windows: DataFrame) -> DataFrame:
    """low, medium or high by the deviation of the steps of z."""
    step = F.col("z") - F.lag("z").over(per_window().orderBy("i"))
    d = with_z(windows).withColumn("d", step).groupBy(*KEY).agg(F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("step_std"))
    return d.select(*KEY, "step_std", F.when(F.col("step_std") < 0.5, "low").when(F.col("step_std") < 1.0, "medium").otherwise("high").alias("volatility"))


def strength_label(has: Column, strength: Column) -> Column:
    """Seasonality strength as a word."""
    return F.when(~has, "none").when(strength >= 0.6, "strong").when(strength >= 0.4, "medium").when(strength >= 0.25, "weak").otherwise("none")


def series_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    """mean, std (with 1e-6 under the root), min, max, relative change and length of each group of points."""
    agg = points.groupBy(*keys).agg(F.avg("value").alias("mean"), F.sqrt(F.var_pop("value") + 1e-6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.min_by("value", "t").alias("a"), F.max_by("value", "t").alias("b"), F.count("*").alias("length"))
    return agg.select(*keys, "mean", "std", "min", "max", ((F.col("b") - F.col("a")) / (F.abs("a") + 1e-6)).alias("change"), "length")


def instance_norm(windows: DataFrame) -> DataFrame:
    """Adds normed = (value - mean) / sqrt(var + 1e-5) and restored, its inverse."""
    root = F.sqrt(F.var_pop("value").over(per_window()) + 1e-5)
    out = windows.withColumns({"level": mean_of(), "root": root}).withColumn("normed", (F.col("value") - F.col("level")) / F.col("root"))
    return out.withColumn("restored", F.col("normed") * F.col("root") + F.col("level")).drop("level", "root")


def _fit(windows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return windows.groupBy(*keys).agg(F.regr_slope("value", "i").alias("slope"), F.count("*").alias("m"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def classed(ratio: Column) -> Column:
    """Five trend classes by the fitted change over the range."""
    return F.when(ratio > 0.3, "strong_up").when(ratio > 0.1, "mild_up").when(ratio < -0.3, "strong_down").when(ratio < -0.1, "mild_down").otherwise("flat")


def fitted_share(slope: Column, m: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.coalesce(slope, F.lit(0.0)) * m / (high - low)).otherwise(F.lit(0.0))


def trend_class(windows: DataFrame) -> DataFrame:
    ratio = fitted_share(F.col("slope"), F.col("m"), F.col("low"), F.col("high"))
    return _fit(windows).select(*KEY, ratio.alias("ratio"), classed(ratio).alias("trend_class"))


def relative_volatility(windows: DataFrame) -> DataFrame:
    ratio = F.col("std") / (F.abs("mean") + 1e-6)
    return _fit(windows).select(*KEY, ratio.alias("ratio"), F.when(ratio < 0.05, "low").when(ratio < 0.15, "medium").otherwise("high").alias("volatility"))


def segment_table(windows: DataFrame, k: int = 4) -> DataFrame:
    """mean, std, volatility against the whole window, and trend class of each of k equal segments."""
    part = windows.withColumn("all_std", std_of()).withColumn("seg", equal_segment(F.col("i"), F.col("n"), k))
    each = part.groupBy(*KEY, "seg").agg(F.regr_slope("value", "i").alias("slope"), F.count("*").alias("m"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("all_std").alias("all_std"))
    ratio = F.col("std") / (F.col("all_std") + 1e-6)
    vol = F.when(ratio < 0.7, "low").when(ratio > 1.3, "high").otherwise("medium")
    return each.select(*KEY, "seg", "mean", "std", vol.alias("volatility"), classed(fitted_share(F.col("slope"), F.col("m"), F.col("low"), F.col("high"))).alias("trend_class"))


def trend_strength(segments: DataFrame) -> DataFrame:
    """Direction at a mean slope of 0.01 and strength at 0.015 and 0.06."""
    avg = F.avg("slope_z")
    agg = segments.groupBy(*KEY).agg(avg.alias("s"))
    size = F.abs("s")
    return agg.select(*KEY, F.when(F.col("s") > 0.01, "up").when(F.col("s") < -0.01, "down").otherwise("flat").alias("direction"), F.when(size < 0.015, "weak").when(size < 0.06, "moderate").otherwise("strong").alias("strength"))


def window_label(points: DataFrame, mode: str = "any", constant: int = 0) -> DataFrame:
    """One label a window from its points' labels: any, majority, first, mode (smallest on ties) or constant."""
    if mode == "mode":
        counts = points.groupBy(*KEY, "label").agg(F.count("*").alias("c"))
        first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("c"), "label"))
        return counts.withColumn("r", first).where("r = 1").select(*KEY, F.col("label").cast("int").alias("window_label"))
    rule = {"any": F.max("label"), "majority": (F.avg("label") >= 0.5).cast("int"), "first": F.min_by("label", "i"), "constant": F.max(F.lit(constant))}[mode]
    return points.groupBy(*KEY).agg(rule.cast("int").alias("window_label"))


def amplitude(windows: DataFrame) -> DataFrame:
    """start, end, mean, extremes with their first places, net change and range in percent of the mean."""
    part = windows.withColumns({"low": F.min("value").over(per_window()), "high": F.max("value").over(per_window())})
    at = lambda c: F.min(F.when(F.col("value") == F.col(c), F.col("i")))
    agg = part.groupBy(*KEY).agg(F.min_by("value", "i").alias("start_v"), F.max_by("value", "i").alias("end_v"), F.avg("value").alias("mean"), F.first("low").alias("min_v"), at("low").alias("min_i"), F.first("high").alias("max_v"), at("high").alias("max_i"))
    share = lambda x: F.when(F.abs("mean") <= EPS, F.lit(0.0)).otherwise(x / F.abs("mean") * 100)
    return agg.withColumns({"net_pct": share(F.col("end_v") - F.col("start_v")), "range_pct": share(F.col("max_v") - F.col("min_v"))})


def _trend_of(slope: Column, std: Column) -> Column:
    return F.when(std < EPS, F.lit(0.0)).otherwise(F.coalesce(slope / std, F.lit(0.0)))


def window_features(windows: DataFrame, variables: list[str] = (), extra: list[str] = (), check: bool = False) -> DataFrame:
    """One row a window with all that claims are made of, from one exchange: n, mean, std, scale, trend, start_v, end_v,
    delta_pct, most (the most volatile third), volatility, season, lags (of `variables` against value), and the value,
    variables and `extra` columns as arrays in order of i. With `check` also acf, the period by autocorrelation alone.

    The numbers are those of global_trend(), net_change(), volatility(), volatility_label() and the kernels.
    """
    seg = equal_segment(F.col("i"), F.col("n"), 3)
    own = lambda k: F.when(seg == k, F.col("value"))
    parts = [c for k in range(3) for c in (F.regr_slope(own(k), F.col("i")).alias(f"_slope_{k}"), F.stddev_pop(own(k)).alias(f"_sd_{k}"), F.count(own(k)).alias(f"_c_{k}"))]
    columns = ["value", *variables, *extra]
    agg = windows.groupBy(*KEY, "w_end").agg(
        F.max("n").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min_by("value", "i").alias("start_v"), F.max_by("value", "i").alias("end_v"), *parts, F.array_sort(F.collect_list(F.struct("i", *columns))).alias("_p"),
    )
    of = lambda c: lambda p: p[c]
    # by transform(), not as fields of the array, which Spark would form anew at each place that reads one
    out = agg.select(*[c for c in agg.columns if c != "_p"], *[F.transform("_p", of(c)).alias(c) for c in columns])
    std = F.col("std")
    slopes = [F.when(F.col(f"_c_{k}") > 0, _trend_of(F.col(f"_slope_{k}"), std)) for k in range(3)]
    label = lambda x: F.when(x > 0.03, "up").when(x < -0.03, "down").when(x.isNotNull(), "flat")
    first, last = label(slopes[0]), F.coalesce(*[label(x) for x in slopes[::-1]])
    avg = sum((F.coalesce(x, F.lit(0.0)) for x in slopes), F.lit(0.0)) / 3
    trend = F.when((first == "up") & (last == "down"), "up_then_down").when((first == "down") & (last == "up"), "down_then_up").when(avg > 0.03, "up").when(avg < -0.03, "down").otherwise("flat")
    spread = [F.when(std < EPS, F.lit(0.0)).otherwise(F.coalesce(F.col(f"_sd_{k}"), F.lit(-1.0))) for k in range(3)]
    most = F.when((spread[0] >= spread[1]) & (spread[0] >= spread[2]), 0).when(spread[1] >= spread[2], 1).otherwise(2)
    scale = F.greatest(F.abs("mean"), std, F.lit(EPS))
    m = F.size("value") - 1
    steps = F.zip_with(F.slice("value", 2, F.greatest(m, F.lit(0))), F.slice("value", 1, F.greatest(m, F.lit(0))), lambda a, b: a - b)
    # the mean of the steps is (end - start) / m, so one pass gives their deviation
    step_var = F.aggregate(steps, F.lit(0.0), lambda a, d: a + (d - (F.col("end_v") - F.col("start_v")) / m) * (d - (F.col("end_v") - F.col("start_v")) / m)) / m
    step_std = F.when((std < EPS) | (m < 1), F.lit(0.0)).otherwise(F.sqrt(step_var) / std)
    volatility_ = F.when(step_std < 0.5, "low").when(step_std < 1.0, "medium").otherwise("high")
    out = out.withColumns({"scale": scale, "trend": trend, "delta_pct": change_pct(F.col("start_v"), F.col("end_v"), scale), "most": most, "volatility": volatility_})
    out = out.drop(*[c for c in out.columns if c.startswith("_")]).withColumn("season", kernels.season("value"))
    if check:
        out = out.withColumn("acf", kernels.acf_period("value"))
    return out.withColumn("lags", kernels.lagged_corr("value", F.array(*[F.col(v).cast("array<double>") for v in variables])) if variables else F.lit(None).cast(kernels.CORR))
