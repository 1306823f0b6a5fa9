"""Cleaning, repair and reshaping of series and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import last_and_next

#: Noise words of economic series names, removed in this order. Fixed values.
NAME_NOISE = (
    r",\s*(Monthly|Quarterly|Annual|Daily|Weekly)",
    r",\s*(Not )?Seasonally Adjusted",
    r",\s*Index \w+ \d{4}=\d+",
    r"Index \w+ \d{4}=\d+ of",
    r",\s*Millions of Dollars",
    r",\s*Billions of Dollars",
    r",\s*Percent",
)


def to_points(wide: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Wide columns as rows: the keys, var, value."""
    return wide.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "var", "value")


def fill_series(points: DataFrame, keys: list[str], order: str = "t", value: str = "value", policy: str = "ffill_bfill_zero") -> DataFrame:
    """Fills gaps of a series. Policies: ffill_bfill_zero (last known, else next known, else 0), zero, drop.

    Text that is no number and NaN count as gaps. A long series is filled in buckets (operators.scan).
    """
    number = F.col(value) if dict(points.dtypes)[value] in ("double", "float") else F.expr(f"try_cast(`{value}` AS double)")
    clean = points.withColumn(value, F.when(~F.isnan(number), number))
    if policy == "drop":
        return clean.dropna(subset=[value])
    if policy == "zero":
        return clean.withColumn(value, F.coalesce(value, F.lit(0.0)))
    near, before, after = last_and_next(clean, keys, order, value)
    return near.withColumn(value, F.coalesce(before, after, F.lit(0.0))).select(*points.columns)


def fill_array(values: Column) -> Column:
    """As fill_series(), inside an array of doubles."""
    clean = F.transform(values, lambda x: F.when(~F.isnan(x), x))
    forward = F.aggregate(clean, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(x, F.try_element_at(acc, F.lit(-1))))))
    first = F.element_at(F.concat(F.filter(clean, lambda x: x.isNotNull()), F.array(F.lit(0.0))), 1)
    return F.transform(forward, lambda x: F.coalesce(x, first))


def time_text(time: Column | None, t: Column) -> Column:
    """`yyyy-MM-dd HH:mm`, empty if it can't be read as a time; `idx_t` without a time column."""
    if time is None:
        return F.concat(F.lit("idx_"), t.cast("string"))
    return F.coalesce(F.date_format(F.try_to_timestamp(time.cast("string")), "yyyy-MM-dd HH:mm"), F.lit(""))


def variables_meta(columns: DataFrame, meanings: DataFrame, target: Column) -> DataFrame:
    """One row a variable: name, position, role, meaning (the name without an entry), unit (empty without one).

    columns: series_key, cols array. meanings: name, meaning, unit.
    """
    each = columns.select("series_key", target.alias("_target"), F.posexplode("cols").alias("position", "name"))
    joined = each.join(meanings, "name", "left")
    role = F.when(F.col("name") == F.col("_target"), "target").otherwise("feature")
    return joined.select("series_key", "name", "position", role.alias("role"), F.coalesce("meaning", "name").alias("meaning"), F.coalesce("unit", F.lit("")).alias("unit"))


def repair_lengths(rows: DataFrame, max_gap: int = 20) -> DataFrame:
    """Rows of several series (cols, timestamp, series map<string, array<double>>) with their lengths made equal.

    Adds status (kept, trimmed, dropped), reason (the first rule that failed) and length. Rules: some series; as
    many columns as series; no missing list; lengths at most `max_gap` apart, then all are cut to the shortest.
    """
    names = F.filter(F.map_keys("series"), lambda k: k.rlike(r"^timeseries\d+$"))
    lists = F.transform(names, lambda k: F.element_at("series", k))
    sizes = F.concat(F.array(F.coalesce(F.size("timestamp"), F.lit(-1))), F.transform(lists, lambda v: F.coalesce(F.size(v), F.lit(-1))))
    low, high = F.array_min(sizes), F.array_max(sizes)
    reason = (
        F.when(F.col("series").isNull() | (F.size(names) == 0), "no_series").when(F.col("cols").isNull() | (F.size("cols") != F.size(names)), "cols_mismatch").when(low < 0, "missing_list").when(high - low > max_gap, "gap_too_large")
    )
    status = F.when(reason.isNotNull(), "dropped").when(high > low, "trimmed").otherwise("kept")
    out = rows.withColumns({"status": status, "reason": reason, "length": F.when(reason.isNull(), low)})
    cut = F.transform_values("series", lambda k, v: F.when(F.col("length").isNotNull(), F.slice(v, 1, F.col("length"))).otherwise(v))
    return out.withColumn("series", cut).withColumn("timestamp", F.when(F.col("length").isNotNull(), F.slice("timestamp", 1, F.col("length"))).otherwise(F.col("timestamp")))


def repair_report(repaired: DataFrame) -> DataFrame:
    """Number of rows by status and reason."""
    return repaired.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("rows"))


def clean_name(raw: Column) -> Column:
    """A series name without frequency, unit and index notes; of `a; b` the longer-than-four b; no dangling preposition."""
    name = raw
    for pattern in NAME_NOISE:
        name = F.regexp_replace(name, "(?i)" + pattern, "")
    parts = F.split(name, ";")
    second = F.trim(F.try_element_at(parts, F.lit(2)))
    name = F.when(F.instr(name, ";") > 0, F.when(F.length(second) > 4, second).otherwise(F.trim(parts[0]))).otherwise(name)
    name = F.trim(F.regexp_replace(name, r"\s*\(Index.*?\)", ""))
    name = F.regexp_replace(name, r"(?i)\s+(of|in|at|for|by)\s*$", "")
    return F.when(F.length(name) < 3, F.split(raw, ",")[0]).otherwise(name)


def rounded(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    """Doubles and arrays of doubles rounded, in all or the named columns."""
    kinds = dict(df.dtypes)
    new = {}
    for c in columns or df.columns:
        if kinds[c] == "double":
            new[c] = F.round(c, digits)
        elif kinds[c] == "array<double>":
            new[c] = F.transform(c, lambda x: F.round(x, digits))
    return df.withColumns(new) if new else df


def path_value(json: Column, path: str) -> Column:
    """The value at a dotted path (`a.b.0`) of JSON text; null on any miss."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, "$" + steps)


def preferred(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed; null if none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def caption_set(candidates: list[Column], default: str = "A time series.") -> Column:
    """Distinct non-blank candidates with single spaces, in order; the default sentence if there are none."""
    tidy = F.transform(F.array(*candidates), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    kept = F.array_distinct(F.filter(tidy, lambda c: c.isNotNull() & (c != "")))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def transpose(matrix: Column) -> Column:
    """[T][D] as [D][T] and back; rows are as long as the first one."""
    places = F.sequence(F.lit(0), F.size(matrix[0]) - 1)
    return F.when(F.size(matrix) == 0, matrix).otherwise(F.transform(places, lambda d: F.transform(matrix, lambda r: r[d])))


def pending(samples: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("series_key", "w_start", "w_end")) -> DataFrame:
    """Samples that have no output yet; nulls in keys are equal to each other."""
    condition = [samples[k].eqNullSafe(done[k]) for k in keys]
    return samples.join(done, condition, "left_anti")


def after_cursor(samples: DataFrame, series_key, w_start) -> DataFrame:
    """Samples after a cursor in the order (series_key, w_start); none if no sample is at the cursor."""
    known = samples.where((F.col("series_key") == series_key) & (F.col("w_start") == w_start)).select(F.lit(1).alias("_k")).limit(1)
    later = samples.where((F.col("series_key") > series_key) | ((F.col("series_key") == series_key) & (F.col("w_start") > w_start)))
    return later.withColumn("_k", F.lit(1)).join(known, "_k", "left_semi").drop("_k")


def usage_report(rows: DataFrame) -> DataFrame:
    """Token sums and means by file, by (task, length) and in total, by grouping sets.

    rows: file, prompt_tokens, completion_tokens, total_tokens (null: prompt plus completion). level names the set.
    """
    name = r"^(.+)_L(\d+)_(pred|failed)\.jsonl$"
    parsed = rows.select(
        "file", F.regexp_extract("file", name, 1).alias("task"), F.regexp_extract("file", name, 2).cast("int").alias("length"), F.coalesce("prompt_tokens", F.lit(0)).alias("p"), F.coalesce("completion_tokens", F.lit(0)).alias("c"),
        F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("t"),
    )
    sets = parsed.groupingSets([["file"], ["task", "length"], []], "file", "task", "length")
    level = F.when(F.grouping("file") == 0, "file").when(F.grouping("task") == 0, "task").otherwise("total")
    return sets.agg(level.alias("level"), F.count("*").alias("samples"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("t").alias("total_tokens"), F.avg("t").alias("mean_tokens"))
