"""Events inside windows: slope segments, extrema, ramps, phases, excursions and questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .features import EPS, per_window, with_z
from .windows import KEY, even_cut


def in_order() -> WindowSpec:
    return per_window().orderBy("i")


def smoothed_slope(windows: DataFrame) -> DataFrame:
    """Adds slope: steps of z (padded by a copy at both ends), averaged over five with zeros outside. Null at the last point."""
    z = windows if "z" in windows.columns else with_z(windows)
    steps = z.withColumn("d", F.lead("z").over(in_order()) - F.col("z"))
    five = F.coalesce(F.sum("d").over(in_order().rowsBetween(-2, 2)), F.lit(0.0))
    head = F.when(F.col("i") <= 1, F.first("d").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).otherwise(0.0)
    last = F.max(F.when(F.col("i") == F.col("n") - 2, F.col("d"))).over(per_window())
    tail = F.when(F.col("i") >= F.col("n") - 3, last).otherwise(0.0)
    return steps.withColumn("slope", F.when(F.col("i") < F.col("n") - 1, (five + head + tail) / 5))


def slope_runs(windows: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Adds sign (of the smoothed slope at the threshold) and run, the number of its run of equal signs."""
    s = smoothed_slope(windows)
    sign = F.when(F.col("n") <= 3, 0).when(F.col("slope") > threshold, 1).when(F.col("slope") < -threshold, -1).otherwise(0)
    signed = s.withColumn("sign", F.when(F.col("slope").isNotNull(), sign))
    turn = (F.coalesce(F.col("sign") != F.lag("sign").over(in_order()), F.lit(False))).cast("int")
    return signed.withColumn("run", F.when(F.col("slope").isNotNull(), F.sum(turn).over(in_order())))


def segmented(windows: DataFrame, least: int = 10) -> DataFrame:
    """Points with the segment they belong to; a point between two segments is in both rows.

    A run of steps begins a segment if it is the first one or spans at least `least` points; shorter runs join the
    segment before. Adds seg, label (sign of the segment's first run).
    """
    runs = slope_runs(windows)
    of_run = Window.partitionBy(*KEY, "run")
    size = F.count("slope").over(of_run) + 1
    head = ((F.col("i") == F.min("i").over(of_run)) & ((F.col("run") == 0) | (size >= least)) & F.col("slope").isNotNull()).cast("int")
    numbered = runs.withColumn("head", head).withColumn("seg", F.sum("head").over(in_order()) - 1)
    first = numbered.withColumn("label", F.last(F.when(F.col("head") == 1, F.col("sign")), ignorenulls=True).over(in_order()))
    before, label = F.lag("seg").over(in_order()), F.lag("label").over(in_order())
    own = F.when((F.col("i") < F.col("n") - 1) | (F.col("n") == 1), F.struct(F.col("seg"), F.col("label")))
    other = F.when((F.col("i") == F.col("n") - 1) | (before != F.col("seg")), F.struct(before.alias("seg"), label.alias("label")))
    placed = first.withColumns({"own": own, "other": other}).withColumn("in", F.explode(F.array("own", "other"))).where("in.seg is not null")
    return placed.drop("own", "other").drop("seg", "label", "head", "sign", "run").withColumns({"seg": F.col("in.seg"), "label": F.col("in.label")}).drop("in")


def slope_segments(windows: DataFrame, least: int = 10) -> DataFrame:
    """seg, start, end, label (-1, 0, 1) and slope (of z) of each segment."""
    each = segmented(windows, least).groupBy(*KEY, "seg").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.first("label").alias("label"), F.coalesce(F.regr_slope("z", "i"), F.lit(0.0)).alias("slope"))
    return each


def extrema(windows: DataFrame, z_least: float = 1.0) -> DataFrame:
    """Strict local maxima with z at or above the bound and minima at or below its negative: kind, i, z, delta_pct."""
    z = with_z(windows)
    low, high = F.lag("z").over(in_order()), F.lead("z").over(in_order())
    peak = (F.col("z") > low) & (F.col("z") > high) & (F.col("z") >= z_least)
    valley = (F.col("z") < low) & (F.col("z") < high) & (F.col("z") <= -z_least)
    kind = F.when(peak, "peak").when(valley, "valley")
    found = z.withColumn("kind", kind).where("kind is not null")
    return found.select(*KEY, "kind", "i", "z", "value", ((F.col("value") - F.col("mean")) / F.col("scale") * 100).alias("delta_pct"))


def thin(events: DataFrame, distance: int = 5) -> DataFrame:
    """Keeps, in order of i, each event at least `distance` after the last one kept, by window and kind."""
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (x["i"] - F.element_at(acc, -1)["i"] >= distance), F.concat(acc, F.array(x))).otherwise(acc)
    rest = [c for c in events.columns if c not in (*KEY, "kind", "i")]
    lists = events.groupBy(*KEY, "kind").agg(F.array_sort(F.collect_list(F.struct("i", *rest))).alias("e"))
    kind = lists.schema["e"].dataType.simpleString()
    kept = F.aggregate("e", F.array().cast(kind), keep)
    return lists.select(*KEY, "kind", F.inline(kept))


def top_events(events: DataFrame, count: int = 3) -> DataFrame:
    """The `count` events of greatest abs(z) of each window and kind; rank from 0."""
    order = Window.partitionBy(*KEY, "kind").orderBy(F.desc(F.abs("z")), "i")
    return events.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < count)


def ramps(windows: DataFrame, least: int = 24, z_change: float = 0.8, count: int = 3) -> DataFrame:
    """Long steep segments: kind, start, end, delta_z, delta_pct; the `count` of greatest abs(delta_z), rank from 0.

    Segments share at most their ends, so at these lengths no two chosen ramps overlap by a third.
    """
    parts = segmented(windows, 10).groupBy(*KEY, "seg").agg(
        F.min("i").alias("start"), F.max("i").alias("end"), F.first("label").alias("label"), F.min_by("z", "i").alias("z0"), F.max_by("z", "i").alias("z1"), F.min_by("value", "i").alias("v0"), F.max_by("value", "i").alias("v1"), F.first("scale").alias("scale"),
    )
    delta = F.col("z1") - F.col("z0")
    steep = parts.withColumn("delta_z", delta).where((F.col("label") != 0) & (F.col("end") - F.col("start") + 1 >= least) & (F.abs("delta_z") >= z_change))
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.abs("delta_z")), "start")
    ranked = steep.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < count)
    return ranked.select(*KEY, "rank", F.when(F.col("label") > 0, "ramp_up").otherwise("ramp_down").alias("kind"), "start", "end", "delta_z", ((F.col("v1") - F.col("v0")) / F.col("scale") * 100).alias("delta_pct"))


def phases(windows: DataFrame, least: int = 20, fallback: int = 3) -> DataFrame:
    """The window's phases: slope segments of at least `least` points, or equal thirds if there are fewer than two.

    phase, start, end, label, start_v, end_v, delta_pct, min_v, min_i, max_v, max_i, std (over the scale).
    """
    parts = segmented(windows, least).withColumn("segs", F.max("seg").over(per_window()) + 1)
    third = sum((F.col("i") >= even_cut(F.lit(k), F.col("n"), fallback)).cast("int") for k in range(1, fallback))
    one = F.col("segs") < 2
    own = parts.withColumn("phase", F.when(one, third).otherwise(F.col("seg")).cast("int")).dropDuplicates([*KEY, "phase", "i"])
    agg = own.groupBy(*KEY, "phase").agg(
        F.min("i").alias("start"), F.max("i").alias("end"), F.min_by("value", "i").alias("start_v"), F.max_by("value", "i").alias("end_v"), F.stddev_pop("value").alias("sd"), F.first("scale").alias("scale"), F.first("n").alias("n"),
        F.min(F.struct("value", "i")).alias("lo"), F.max(F.struct(F.col("value"), (-F.col("i")).alias("j"))).alias("hi"),
    )
    delta, scale = F.col("end_v") - F.col("start_v"), F.col("scale")
    label = F.when(F.abs(delta) <= 0.01 * scale, "flat").when(delta > 0, "up").otherwise("down")
    return agg.where("end > start").select(*KEY, "n", "phase", "start", "end", label.alias("label"), "start_v", "end_v", (delta / scale * 100).alias("delta_pct"), F.col("lo.value").alias("min_v"), F.col("lo.i").alias("min_i"), F.col("hi.value").alias("max_v"), (-F.col("hi.j")).alias("max_i"), (F.col("sd") / scale).alias("std"))


def score_of(start: Column, end: Column, start_v: Column, end_v: Column, delta_pct: Column, min_v: Column, max_v: Column, std: Column) -> Column:
    """Of a phase: change, length, spread, and a bonus if an inner extreme goes well beyond both ends."""
    bound = F.greatest(1.5 * F.abs(end_v - start_v), 0.05 * F.abs(start_v), F.lit(1e-8))
    beyond = (max_v > F.greatest(start_v, end_v) + bound) | (min_v < F.least(start_v, end_v) - bound)
    return F.abs(delta_pct) + 3.0 * F.log1p(end - start + 1) + 50.0 * std + 10.0 * F.when(beyond, 1.0).otherwise(0.0)


def phase_score(phase: DataFrame) -> DataFrame:
    """Adds score, see score_of()."""
    return phase.withColumn("score", score_of(*map(F.col, ("start", "end", "start_v", "end_v", "delta_pct", "min_v", "max_v", "std"))))


def with_events(rows: DataFrame, distance: int = 5, count: int = 3) -> DataFrame:
    """One row a window (value: its points in order; mean, std, scale) with its events as arrays of structs: peaks and
    valleys (i, z, value, delta_pct), ramps (kind, start, end, delta_pct), phases (phase, start, end, label, start_v,
    end_v, delta_pct, min_v, max_v, std).

    They are those of top_events(thin(extrema())), ramps() and phases(), without a sort or an exchange of points; a
    null value is no step.
    """
    n = F.size("value")
    z = F.transform("value", lambda x: F.when(F.col("std") < EPS, F.lit(0.0)).otherwise((x - F.col("mean")) / F.col("std")))
    m = F.greatest(n - 1, F.lit(0))
    step = F.zip_with(F.slice("_z", 2, m), F.slice("_z", 1, m), lambda b, a: F.coalesce(b - a, F.lit(0.0)))
    out = rows.withColumn("_z", z).withColumn("_d", step)

    def sign(d: Column, i: Column) -> Column:
        five = sum((F.coalesce(d if j == 0 else F.get("_d", i + j), F.lit(0.0)) for j in range(-2, 3)), F.lit(0.0))
        head, tail = F.when(i <= 1, F.get("_d", F.lit(0))).otherwise(0.0), F.when(i >= n - 3, F.get("_d", n - 2)).otherwise(0.0)
        slope = (five + head + tail) / 5
        return F.when(n <= 3, 0).when(slope > 0.02, 1).when(slope < -0.02, -1).otherwise(0)

    known = lambda places: F.filter(places, lambda i: i.isNotNull())
    out = out.withColumn("_sign", F.transform("_d", sign))
    out = out.withColumn("_runs", known(F.transform("_sign", lambda s, i: F.when((i == 0) | (s != F.get("_sign", i - 1)), i))))
    heads = lambda least: F.filter("_runs", lambda s, k: (k == 0) | (F.coalesce(F.get("_runs", k + 1), n - 1) - s + 1 >= least))
    spans = lambda h: F.transform(h, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(h, k + 1), n - 1).alias("end"), F.get("_sign", s).alias("label")))
    at = lambda i: F.get("value", i)
    scale = F.col("scale")

    out = out.withColumns({"_long": heads(10), "_parts": heads(20)}).withColumns({"_long": spans(F.col("_long")), "_parts": spans(F.col("_parts"))})
    steep = F.filter("_long", lambda s: (s["label"] != 0) & (s["end"] - s["start"] + 1 >= 24))
    rising = F.transform(steep, lambda s: F.struct((-F.abs(F.get("_z", s["end"]) - F.get("_z", s["start"]))).alias("o"), *[s[c].alias(c) for c in ("start", "end", "label")]))
    top = F.slice(F.array_sort(F.filter(rising, lambda s: s["o"] <= -0.8)), 1, count)
    ramps_ = F.transform(top, lambda s: F.struct(F.when(s["label"] > 0, "ramp_up").otherwise("ramp_down").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), ((at(s["end"]) - at(s["start"])) / scale * 100).alias("delta_pct")))

    cuts = [F.lit(0), *[even_cut(F.lit(k), n, 3).cast("int") for k in (1, 2)], n]
    thirds = F.array(*[F.struct(a.alias("start"), (b - 1).alias("end")) for a, b in zip(cuts, cuts[1:], strict=False)])
    own = F.when(F.size("_parts") < 2, thirds).otherwise(F.transform("_parts", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    numbered = F.transform(own, lambda s, k: F.struct(k.alias("phase"), s["start"].alias("start"), s["end"].alias("end")))
    values = lambda s: F.array_compact(F.slice("value", s["start"] + 1, s["end"] - s["start"] + 1))
    cut = F.transform(F.filter(numbered, lambda s: s["end"] > s["start"]), lambda s: F.struct(*[s[c].alias(c) for c in ("phase", "start", "end")], values(s).alias("v")))
    level = F.transform("_cut", lambda s: F.struct(s.alias("s"), (F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(s["v"]), F.lit(0))).alias("mean")))

    def phase(p: Column) -> Column:
        s, start_v, end_v = p["s"], at(p["s"]["start"]), at(p["s"]["end"])
        sd = F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - p["mean"]) * (x - p["mean"])) / F.nullif(F.size(s["v"]), F.lit(0)))
        label = F.when(F.abs(end_v - start_v) <= 0.01 * scale, "flat").when(end_v - start_v > 0, "up").otherwise("down")
        ends = [s["phase"].alias("phase"), s["start"].alias("start"), s["end"].alias("end"), label.alias("label"), start_v.alias("start_v"), end_v.alias("end_v"), ((end_v - start_v) / scale * 100).alias("delta_pct")]
        return F.struct(*ends, F.array_min(s["v"]).alias("min_v"), F.array_max(s["v"]).alias("max_v"), (sd / scale).alias("std"))

    def strongest(is_one) -> Column:
        places = known(F.transform("_z", lambda x, i: F.when(is_one(x, F.get("_z", i - 1), F.get("_z", i + 1)), i)))
        keep = lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(acc, -1) >= distance), F.concat(acc, F.array(i))).otherwise(acc)
        kept = F.aggregate(places, F.array().cast("array<int>"), keep)
        order = F.slice(F.array_sort(F.transform(kept, lambda i: F.struct((-F.abs(F.get("_z", i))).alias("o"), i.alias("i")))), 1, count)
        return F.transform(order, lambda p: F.struct(p["i"].alias("i"), F.get("_z", p["i"]).alias("z"), at(p["i"]).alias("value"), ((at(p["i"]) - F.col("mean")) / scale * 100).alias("delta_pct")))

    peaks = strongest(lambda x, low, high: (x >= 1.0) & (x > low) & (x > high))
    valleys = strongest(lambda x, low, high: (x <= -1.0) & (x < low) & (x < high))
    out = out.withColumns({"ramps": ramps_, "_cut": cut, "peaks": peaks, "valleys": valleys}).withColumn("_level", level).withColumn("phases", F.transform("_level", phase))
    return out.drop("_z", "_d", "_sign", "_runs", "_long", "_parts", "_cut", "_level")


def z_events(windows: DataFrame, bound: float = 2.5) -> DataFrame:
    """Runs of points with abs(z) at or above the bound: start, end, peak_i (first greatest abs(z)), z, rank by abs(z) from 0."""
    z = with_z(windows).where(F.abs("z") >= bound)
    island = z.withColumn("g", F.col("i") - F.row_number().over(in_order()))
    each = island.groupBy(*KEY, "g").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.max(F.struct(F.abs("z").alias("a"), (-F.col("i")).alias("j"), F.col("z"))).alias("top"))
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.abs("z")), "start")
    return each.select(*KEY, "start", "end", (-F.col("top.j")).alias("peak_i"), F.col("top.z").alias("z")).withColumn("rank", F.row_number().over(order) - 1)


def lift(windows: DataFrame) -> DataFrame:
    """Adds lift: the value less the mean of the five points before it; at the first point less the window's mean."""
    before = F.coalesce(F.avg("value").over(in_order().rowsBetween(-5, -1)), F.avg("value").over(per_window()))
    return windows.withColumn("lift", F.col("value") - before)


def spike_segments(events: DataFrame, z_least: float = 2.0, wide: int = 3) -> DataFrame:
    """Extremes of abs(z) at or above the bound, widened to both sides: kind spike or drop, start (not below 0), end."""
    kept = events.where(F.abs("z") >= z_least)
    return kept.select(*KEY, F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"), F.greatest(F.lit(0), F.col("i") - wide).alias("start"), (F.col("i") + wide).alias("end"), "z")


def longest_rise(windows: DataFrame, least: int = 5) -> DataFrame:
    """The greatest number of successive rising steps, and whether it reaches `least`."""
    up = windows.withColumn("up", (F.col("value") > F.lag("value").over(in_order())).cast("int"))
    group = up.withColumn("g", F.sum(F.when(F.col("up") == 1, 0).otherwise(1)).over(in_order()))
    runs = group.groupBy(*KEY, "g").agg(F.sum("up").alias("steps"))
    return runs.groupBy(*KEY).agg(F.coalesce(F.max("steps"), F.lit(0)).alias("longest")).withColumn("long", F.col("longest") >= least)


def first_crossing(windows: DataFrame, low: Column, high: Column) -> DataFrame:
    """A if the value goes above `high` before it goes below `low`, B the other way round, else none."""
    agg = windows.groupBy(*KEY).agg(F.min(F.when(F.col("value") > high, F.col("i"))).alias("up"), F.min(F.when(F.col("value") < low, F.col("i"))).alias("down"))
    a, b = F.coalesce("up", F.lit(1 << 40)), F.coalesce("down", F.lit(1 << 40))
    return agg.select(*KEY, "up", "down", F.when(a < b, "A").when(b < a, "B").otherwise("none").alias("first"))


def quantile_position(windows: DataFrame, place: Column) -> DataFrame:
    """Whether the value at a marked place is in the top quarter (A), the bottom one (C) or between (B)."""
    agg = windows.groupBy(*KEY).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.max(F.when(F.col("i") == place, F.col("value"))).alias("marked"))
    return agg.select(*KEY, "marked", F.when(F.col("marked") >= F.col("q")[1], "A").when(F.col("marked") <= F.col("q")[0], "C").otherwise("B").alias("position"))


def argmax_position(windows: DataFrame) -> DataFrame:
    """1-based place of the first maximum, the value there as text, and the quarter it lies in (1 to 4)."""
    top = windows.groupBy(*KEY, "n").agg(F.max(F.struct(F.col("value"), (-F.col("i")).alias("j"))).alias("t"))
    i = -F.col("t.j")
    quarter = F.least(F.floor(i / F.greatest(F.floor(F.col("n") / 4), F.lit(1))), F.lit(3)) + 1
    return top.select(*KEY, (i + 1).alias("place"), F.format_string("%.2f", F.col("t.value")).alias("text"), quarter.cast("int").alias("quarter"))


def trend_question(windows: DataFrame) -> DataFrame:
    """A rising, B falling, C neither: the slope against a thousandth of the range."""
    agg = windows.groupBy(*KEY).agg(F.coalesce(F.regr_slope("value", "i"), F.lit(0.0)).alias("k"), (F.max("value") - F.min("value")).alias("span"))
    bound = 0.001 * (F.col("span") + 1e-6)
    return agg.select(*KEY, F.when(F.col("k") > bound, "A").when(F.col("k") < -bound, "B").otherwise("C").alias("answer"))


def volatile_half(windows: DataFrame) -> DataFrame:
    """A or B for the half of greater deviation; windows where they differ by under 5 % are left out."""
    half = F.floor(F.col("n") / 2)
    agg = windows.groupBy(*KEY).agg(F.stddev_pop(F.when(F.col("i") < half, F.col("value"))).alias("s1"), F.stddev_pop(F.when(F.col("i") >= half, F.col("value"))).alias("s2"))
    clear = agg.where(F.abs(F.col("s1") - F.col("s2")) >= 0.05 * F.greatest("s1", "s2"))
    return clear.select(*KEY, F.when(F.col("s1") > F.col("s2"), "A").otherwise("B").alias("answer"))


def next_step(points: DataFrame, length: int, stride: int) -> DataFrame:
    """A up or B down for the step after each window; small steps and windows at the series' end are left out."""
    from .windows import sliding_windows

    ahead = points.withColumn("next", F.lead("value").over(Window.partitionBy("series_key").orderBy("t")))
    agg = sliding_windows(ahead, length, stride).groupBy(*KEY).agg(F.max_by("value", "i").alias("last"), F.max_by("next", "i").alias("next"), F.stddev_pop("value").alias("std"))
    step = F.col("next") - F.col("last")
    return agg.where(step.isNotNull() & (F.abs(step) >= 0.1 * (F.col("std") + 1e-6))).select(*KEY, F.when(step > 0, "A").otherwise("B").alias("answer"))


def question_items(tasks: dict[str, DataFrame], length: int, count: int) -> DataFrame:
    """All tasks' answers as one table, at most `count` a task, in the order of window start and series."""
    parts = [df.select(F.lit(task).alias("task"), F.lit(length).alias("length"), *KEY, F.col("answer").cast("string").alias("answer")) for task, df in sorted(tasks.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("task", "length").orderBy("w_start", "series_key")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).drop("r")
