"""Readers of the input formats; all schemas are explicit, bad rows become nulls or are dropped as each one says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import fill_array
from ..operators.scan import numbered

# Names that a time column may have, in order of preference.
TIME_NAMES = ("date", "datetime", "timestamp", "time", "Date", "Datetime", "Timestamp", "Time")
# Cells of a numeric column: numbers, blanks and the marks of missing values that pandas reads.
NUMBER = r"^\s*(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?i:inf|infinity)|#N/A|#N/A N/A|#NA|-1\.#IND|-1\.#QNAN|1\.#IND|1\.#QNAN|-?NaN|-?nan|<NA>|N/A|NA|NULL|None|n/a|null)?\s*$"
RECORD = """dataset string, task string, series_key string, indices array<int>, time array<string>, timeseries array<array<double>>,
 variables array<struct<name: string, index: int, role: string, meaning: string, unit: string>>, label string,
 features struct<trend: string, volatility: string, seasonality: struct<period: int, strength: string>, correlations: array<struct<pair: array<string>, rho: double>>>,
 claims array<struct<id: string, type: string, target: string, start: int, end: int, idx: int, t_start: string, t_end: string, t_idx: string,
  data: struct<label: string, label_final: string, label_raw: string, kind: string, start_v: double, end_v: double, delta_pct: double, value: double, z: double, delta_pct_vs_mean: double, has: boolean, period: int, strength: double, most: int, var: string, corr: double, lag: int, stable: boolean, note: string>, sentence: string, ok: boolean, reason: string>>,
 claim_check struct<pass: boolean, n: int, n_failed: int>, descriptions array<string>,
 dense_captions struct<global: struct<zh: string, en: string>, domain_integrated: struct<zh: string, en: string>, local: array<struct<start: int, end: int, t_start: string, t_end: string, type: string, description_zh: string, description_en: string>>, time_kind: string>,
 domain_context string""".replace("\n", "")


def time_column(columns: list[str]) -> str:
    """The first preferred name that is there, else the first column."""
    return next((n for n in TIME_NAMES if n in columns), columns[0])


def value_columns(df: DataFrame, time_col: str) -> list[str]:
    numeric = (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name != time_col]


def target_column(columns: list[str], dataset: str = "") -> str:
    """The last value column; the first one for electricity and traffic."""
    return columns[0] if dataset.lower() in ("electricity", "traffic") else columns[-1]


def read_wide_csv(spark: SparkSession, path: str, time_col: str | None = None, series_cols: list[str] | None = None) -> DataFrame:
    """A CSV with header as text time and double values; names are trimmed, cells that are no number are null.

    Without `series_cols`, series are the columns whose cells are all numbers or missing, told by one aggregate over all
    rows.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    time_col = time_col or time_column(raw.columns)
    if series_cols is None:
        rest = [c for c in raw.columns if c != time_col]
        others = raw.agg(F.lit(0), *[F.count_if(~F.col(f"`{c}`").rlike(NUMBER)) for c in rest]).first()[1:]
        series_cols = [c for c, n in zip(rest, others, strict=True) if n == 0]
    return raw.select(F.col(f"`{time_col}`").alias(time_col), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in series_cols])


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds `line`, the place of a text line in its file, in two steps: counts by partition, then places within."""
    ids = lines.withColumn("_m", F.monotonically_increasing_id())
    part = ids.withColumn("_p", F.shiftrightunsigned("_m", 33))
    starts = part.groupBy("file", "_p").agg(F.count("*").alias("c"), F.min("_m").alias("_lo"))
    before = F.sum("c").over(Window.partitionBy("file").orderBy("_p")) - F.col("c")
    return part.join(starts.withColumn("_before", before), ["file", "_p"]).withColumn("line", F.col("_before") + F.col("_m") - F.col("_lo")).drop("_m", "_p", "_lo", "_before", "c")


def parse_labelled(lines: DataFrame, separator: str = "\t", label_last: bool = False) -> DataFrame:
    """Text rows `value` of a label and values: label int (null if bad), values with gaps filled, size."""
    cells = F.split(F.trim("value") if separator != "\t" else F.col("value"), separator)
    cell = F.element_at(cells, -1) if label_last else cells[0]
    rest = F.slice(cells, F.lit(1), F.size(cells) - 1) if label_last else F.slice(cells, F.lit(2), F.size(cells) - 1)
    out = lines.where(F.trim("value") != "").withColumn("_label", cell).withColumn("_rest", rest)
    numbers = F.transform("_rest", lambda v: v.try_cast("double"))
    return out.select(*[c for c in lines.columns if c != "value"], F.expr("cast(try_cast(_label AS double) AS int)").alias("label"), fill_array(numbers).alias("values")).withColumn("size", F.size("values"))


def read_labelled(spark: SparkSession, path: str, name: str, split: str, separator: str = "\t", label_last: bool = False) -> DataFrame:
    """Labelled rows with series_key `name/split/000000` by line."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    keyed = _numbered(lines).withColumn("series_key", F.format_string(f"{name}/{split}/%06d", "line"))
    return parse_labelled(keyed, separator, label_last)


def parse_metric_rows(rows: DataFrame) -> DataFrame:
    """timestamp, value as text: adds ts, value double; rows where either is bad are dropped. A trailing Z is cut."""
    ts = F.try_to_timestamp(F.regexp_replace(F.trim("timestamp"), "Z$", ""))
    out = rows.withColumn("ts", ts).withColumn("value", F.expr("try_cast(value AS double)"))
    return out.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files (timestamp, value) below a folder: series_key (path from the root), ts, value, t."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema("timestamp string, value string").csv(root, header=True)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\\", "/")
    key = F.regexp_replace(path, r"^.*" + base.replace(".", r"\.") + "/", "")
    rows = parse_metric_rows(raw.select(key.alias("series_key"), "timestamp", "value")).drop("timestamp")
    return numbered(rows, ["series_key"], ["ts", "value"])


def parse_interval_map(rows: DataFrame, column: str) -> DataFrame:
    """JSON text {path: [[start, end], ...]} as series_key, a, b; bad pairs are dropped, ends put in order."""
    maps = rows.select(F.explode(F.from_json(column, "map<string, array<array<string>>>")).alias("series_key", "pairs"))
    pairs = maps.select(F.regexp_replace("series_key", r"\\", "/").alias("series_key"), F.explode("pairs").alias("p")).where(F.size("p") == 2)
    ends = pairs.select("series_key", F.try_to_timestamp(F.col("p")[0]).alias("s"), F.try_to_timestamp(F.col("p")[1]).alias("e")).dropna()
    return ends.select("series_key", F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return parse_interval_map(spark.read.text(path, wholetext=True), "value")


def read_point_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON {path: [timestamp, ...]} as series_key, ts."""
    maps = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("series_key", "list"))
    return maps.select("series_key", F.explode("list").alias("x")).select("series_key", F.try_to_timestamp("x").alias("ts")).dropna()


def parse_economic(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines with dynamic timeseriesN keys: index, cols, timestamp, series map, message. Bad lines and rows
    without columns or timestamps are skipped."""
    texts = lines.select(F.from_json(column, "map<string, string>").alias("m")).where("m is not null")
    get = lambda k: F.try_element_at("m", F.lit(k))
    names = F.map_filter("m", lambda k, _: k.rlike(r"^timeseries\d+$"))
    series = F.transform_values(names, lambda _, v: F.from_json(v, T.ArrayType(T.DoubleType())))
    out = texts.select(get("index").alias("index"), F.from_json(get("cols"), T.ArrayType(T.StringType())).alias("cols"), F.from_json(get("timestamp"), T.ArrayType(T.StringType())).alias("timestamp"), series.alias("series"), get("message").alias("message"))
    return out.where((F.size("cols") > 0) & (F.size("timestamp") > 0))


def economic_points(rows: DataFrame, target: int | str | None = None) -> DataFrame:
    """One series for each column (or only the one by number or name): values of timeseriesN by place; a missing
    key or null value counts as zero."""
    each = rows.select("index", "timestamp", "series", F.posexplode("cols").alias("position", "name"))
    if target is not None:
        each = each.where(F.col("position") == target if isinstance(target, int) else F.col("name") == target)
    own = F.try_element_at("series", F.concat(F.lit("timeseries"), (F.col("position") + 1).cast("string")))
    points = each.withColumn("v", own).select("index", "position", "name", "v", F.posexplode("timestamp").alias("t", "time"))
    return points.select("index", "position", "name", "t", "time", F.coalesce(F.try_element_at("v", F.col("t") + 1), F.lit(0.0)).alias("value"))


def read_economic(spark: SparkSession, path: str) -> DataFrame:
    return parse_economic(spark.read.text(path))


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Caption records as JSON lines with their explicit nested schema, from all files below the paths; a folder a data
    set (`dataset=name`) names the data set of its files."""
    read = spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(list(paths))
    if "dataset" not in read.columns:
        return read
    named = F.url_decode(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/dataset=([^/]*)/", 1), F.lit("")))
    return read.withColumn("dataset", F.coalesce("dataset", named))


def read_readme(spark: SparkSession, path: str, most: int = 8000) -> DataFrame:
    """path, text of each file, cut at `most` characters (a documented limit of the format)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring("value", 1, most).alias("text"))


def read_shards(spark: SparkSession, glob: str) -> DataFrame:
    """Record files of one run, tagged with source_dataset: the file's name without ucr_ and _train.jsonl."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"ucr_|_train\.jsonl", "")
    return spark.read.schema(RECORD).json(glob).withColumn("source_dataset", name)


# Layouts of the data sets that have one of their own; others are wide tables.
DATASETS = {"fred": "economic", "ucr2018": "labelled", "nab": "metrics"}


def layout_of(name: str) -> str:
    return DATASETS.get(name, "wide")


def read_dataset(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Reader by dataset name: fred, ucr2018, nab, else a wide CSV."""
    layout = layout_of(name)
    if layout == "economic":
        return read_economic(spark, path)
    if layout == "labelled":
        return read_labelled(spark, path, options.get("series", "series"), options.get("split", "TRAIN"))
    if layout == "metrics":
        return read_metrics(spark, path)
    return read_wide_csv(spark, path, **options)
