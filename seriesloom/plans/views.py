"""The driver's tables in the roles of the library's inputs, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import dealt
from ..operators.windows import KEY, sliding_windows

LENGTH, STRIDE = 128, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one multivariate series for each supplier."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    t = (F.row_number().over(order) - 1).cast("long")
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines, ["l_suppkey"], lines.count()).select(
        F.col("l_suppkey").alias("series_key"), t.alias("t"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"),
    )


def v_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series for each user."""
    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_key"), t.alias("t"), "ts", "value", "event_type", "props")


def v_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one wide table of days."""
    day = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return day.agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("lines"))


def v_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours around large errors, as anomaly intervals of a user."""
    hit = table(spark, sf_dir, "events").where("event_type = 'error' and value > 100")
    return hit.select(F.col("user_id").alias("series_key"), F.expr("ts - interval 6 hours").alias("a"), F.expr("ts + interval 6 hours").alias("b"))


def supp_windows(spark: SparkSession, sf_dir: str, value: str = "price", extra: list[str] | None = None, by_window: bool = False) -> DataFrame:
    """Windows of suppliers; with `by_window` dealt for window functions, which sort whole windows."""
    size = F.count("*").over(Window.partitionBy("series_key"))  # v_supp() has each series in one task, in order
    points = v_supp(spark, sf_dir).select("series_key", "t", "ts", F.col(value).alias("value"), *(extra or []), size.alias("n_all"))
    windows = sliding_windows(points, LENGTH, STRIDE)
    return dealt(windows, KEY, table(spark, sf_dir, "lineitem").count() * -(-LENGTH // STRIDE)) if by_window else windows


def user_windows(spark: SparkSession, sf_dir: str, length: int = 32, stride: int = 16) -> DataFrame:
    return sliding_windows(v_user(spark, sf_dir).select("series_key", "t", "ts", "value"), length, stride)


SUPP = """supp AS (SELECT l_suppkey AS series_key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t,
 l_shipdate AS ts, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_partkey AS part FROM lineitem)"""
USER = "usr AS (SELECT user_id AS series_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, ts, value, event_type, props FROM events)"
INTERVALS = "intervals AS (SELECT user_id AS series_key, ts - INTERVAL 6 HOUR AS a, ts + INTERVAL 6 HOUR AS b FROM events WHERE event_type = 'error' AND value > 100)"


def window_cte(source: str, length: int, stride: int, name: str = "win") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (w, n_all, t), w * {stride} AS w_start, least(w * {stride} + {length} - 1, n_all - 1) AS w_end, least({length}, n_all) AS n, t - w * {stride} AS i, t
 FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((t - {length} + 1) / {stride}.0) AS BIGINT)), 1 + CASE WHEN n_all < {length} THEN 0 ELSE least(t // {stride}, (n_all - {length}) // {stride}) END)) AS w
 FROM (SELECT *, count(*) OVER (PARTITION BY series_key) AS n_all FROM {source})))"""


WIN = SUPP + ", base AS (SELECT series_key, t, ts, price AS value, qty, disc, tax FROM supp), " + window_cte("base", LENGTH, STRIDE)
UWIN = USER + ", ubase AS (SELECT series_key, t, ts, value FROM usr), " + window_cte("ubase", 32, 16)
