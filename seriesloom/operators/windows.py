"""Windows, segments, crops and patches of series.

A table of points has series_key, t (0-based place) and values; windows add w_start, w_end (inclusive), n (points
of the window) and i (place in the window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import with_size

KEY = ["series_key", "w_start"]


def sliding_windows(points: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """Every point once for each window that holds it; the tail that fills no window is dropped.

    A series shorter than `length`, or a length below 1, gives one window of the whole series. Points are never
    joined to windows: each names its windows by arithmetic. The length of a series comes from counts of its buckets, so
    the points of a long one are never brought together; points that know it already have it as n_all.
    """
    whole = F.lit(length <= 0) | (F.col("n_all") < length)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / F.lit(float(stride)))).cast("long")
    last = F.least(F.floor(F.col("t") / stride), F.floor((F.col("n_all") - length) / stride)).cast("long")
    ids = F.when(whole, F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(first, last))
    sized = points if "n_all" in points.columns else with_size(points, ["series_key"], "t", "n_all")
    out = sized.withColumn("w", F.explode(ids))
    size = F.when(whole, F.col("n_all")).otherwise(F.lit(length)).cast("long")
    out = out.withColumn("w_start", F.when(whole, F.lit(0)).otherwise(F.col("w") * stride).cast("long")).withColumn("n", size)
    return out.withColumn("w_end", F.col("w_start") + F.col("n") - 1).withColumn("i", F.col("t") - F.col("w_start")).drop("w", "n_all")


def window_table(windows: DataFrame) -> DataFrame:
    """One row a window: its key, end and size."""
    return windows.where("i = 0").select("series_key", "w_start", "w_end", "n")


def window_arrays(windows: DataFrame, values: list[str]) -> DataFrame:
    """One row a window with each value column as an array in order of i, for the array kernels."""
    packed = windows.groupBy("series_key", "w_start", "w_end", "n").agg(F.array_sort(F.collect_list(F.struct("i", *values))).alias("p"))
    return packed.select("series_key", "w_start", "w_end", "n", *[F.col(f"p.{v}").alias(v) for v in values])


def limit_windows(windows: DataFrame, count: int, scope: str = "series") -> DataFrame:
    """The first `count` windows of each series, or of all in the order (series_key, w_start)."""
    if scope == "series":
        return windows.withColumn("_r", F.row_number().over(Window.partitionBy("series_key").orderBy("w_start"))).where(F.col("_r") <= count).drop("_r")
    return windows.orderBy("series_key", "w_start").limit(count)


def multi_length_windows(points: DataFrame, lengths: list[int], ratio: float = 0.5) -> DataFrame:
    """Sliding windows of several lengths, each with stride max(1, int(length * ratio)); adds `length`."""
    parts = [sliding_windows(points, n, max(1, int(n * ratio))).where(F.col("n") == n).withColumn("length", F.lit(n).cast("long")) for n in lengths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equal_segment(i: Column, n: Column, k: int) -> Column:
    """Which of k equal segments place i falls in: max(n // k, 1) points each, the last takes the rest."""
    return F.least(F.floor(i / F.greatest(F.floor(n / k), F.lit(1))), F.lit(k - 1)).cast("int")


def even_cut(part: Column, n: Column, k: int = 3) -> Column:
    """Place of the part-th of k+1 even cuts, rounded half to even."""
    return F.bround(part * n / k).cast("long")


def crop_events(events: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """Crops samples to `length` points at a place given by the id, and shifts or clips their events.

    events: sample_id, n (points of the sample), start, end (inclusive). Adds crop; events outside are dropped.
    """
    span = F.greatest(F.col("n") - length + 1, F.lit(1))
    crop = F.pmod(F.xxhash64("sample_id", F.lit(seed)), span)
    return crop_at(events.withColumn("crop", crop), length)


def crop_at(events: DataFrame, length: int) -> DataFrame:
    """As crop_events(), at the place in the column `crop`."""
    low, high = F.greatest("start", "crop"), F.least(F.col("end"), F.col("crop") + length - 1)
    return events.where(low <= high).withColumns({"start": low - F.col("crop"), "end": high - F.col("crop")})


def patchify(points: DataFrame, size: int) -> DataFrame:
    """series_key, patch, values: `size` values a patch, the last one padded with zeros."""
    part = points.withColumn("patch", F.floor(F.col("t") / size)).groupBy("series_key", "patch").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    pad = F.array_repeat(F.lit(0.0), F.lit(size) - F.size("p"))
    return part.select("series_key", "patch", F.concat(F.col("p.value"), pad).alias("values"))


def patch_span(start: Column, end: Column, n: Column, size: int) -> tuple[Column, Column]:
    """Half-open patch span of an inclusive step span: at least one patch wide, inside ceil(n / size) patches."""
    patches = F.ceil(n / size)
    ps = F.least(F.greatest(F.floor(start / size), F.lit(0)), patches - 1)
    pe = F.least(F.greatest(F.ceil((end + 1) / size), ps + 1), patches)
    return ps.cast("long"), pe.cast("long")


def stride_pool(tokens: DataFrame, stride: int) -> DataFrame:
    """Means of `stride` successive token vectors. tokens: id, pos, mask (0/1), vec. Gives id, block, dim, value;
    masked tokens don't count, a block without any is zero."""
    dims = tokens.select("id", "pos", "mask", F.posexplode("vec").alias("dim", "x")).withColumn("block", F.floor(F.col("pos") / stride))
    mean = F.sum(F.when(F.col("mask") == 1, F.col("x"))) / F.sum("mask")
    return dims.groupBy("id", "block", "dim").agg(F.coalesce(mean, F.lit(0.0)).alias("value"))


def patch_heat(scores: DataFrame, size: int) -> DataFrame:
    """Patch scores (id, patch, score) as one value a step, scaled to 0..1 over each id where they differ."""
    every = Window.partitionBy("id")
    low, high = F.min("score").over(every), F.max("score").over(every)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score"))
    steps = F.explode(F.sequence(F.col("patch") * size, (F.col("patch") + 1) * size - 1))
    return scores.withColumn("heat", scaled).select("id", "patch", steps.alias("step"), "heat")
