"""Correlation between the variables of a window, at lag zero and at the best lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import lagged_corr
from .windows import KEY, window_arrays


def against_target(windows: DataFrame, variables: list[str], target: str = "value") -> DataFrame:
    """Long form: one row a point and variable, with x (the variable) and y (the target)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("x")) for v in variables]))
    return windows.select(*KEY, "i", F.col(target).alias("y"), pairs.alias("p")).select(*KEY, "i", "y", "p.var", "p.x")


def guarded_corr(pairs: DataFrame, least: int = 8, eps: float = 1e-8) -> DataFrame:
    """Pearson correlation over finite pairs; null with too few of them or without spread."""
    finite = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    sure = (F.count("*") >= least) & (F.stddev_pop("x") >= eps) & (F.stddev_pop("y") >= eps)
    return finite.groupBy(*KEY, "var").agg(F.when(sure, F.corr("x", "y")).alias("corr"))


def ranked_corr(pairs: DataFrame) -> DataFrame:
    """Zero-lag correlation of each variable with the target, ranked by size from 1."""
    each = pairs.groupBy(*KEY, "var").agg(F.corr("x", "y").alias("corr"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.abs("corr")), "var")))


def best_driver(pairs: DataFrame) -> DataFrame:
    return ranked_corr(pairs).where("rank = 1").drop("rank")


def best_lags(windows: DataFrame, target: str, variables: list[str]) -> DataFrame:
    """Per window and variable: corr and lag on the window (cosine of z-slices) and on its halves (Pearson).

    A positive lag means that the variable leads the target. One Arrow kernel over windows packed as arrays.
    """
    packed = window_arrays(windows, [target, *variables])
    found = packed.withColumn("c", F.explode(lagged_corr(F.col(target), F.array(*[F.col(v) for v in variables]))))
    names = F.array(*[F.lit(v) for v in variables])
    return found.select(*KEY, F.element_at(names, F.col("c.var") + 1).alias("var"), "c.corr", "c.lag", "c.corr_1", "c.lag_1", "c.corr_2", "c.lag_2")


def is_stable(c, least: float = 0.3, tolerance: int = 2) -> Column:
    """Whether both halves (fields corr_1, lag_1, corr_2, lag_2 of `c`) have the sign of the whole, a lag within the
    tolerance and 0.7 of the least correlation."""
    sign = (F.signum(c["corr_1"]) == F.signum(c["corr"])) & (F.signum(c["corr_2"]) == F.signum(c["corr"]))
    near = (F.abs(c["lag_1"] - c["lag"]) <= tolerance) & (F.abs(c["lag_2"] - c["lag"]) <= tolerance)
    return sign & near & (F.abs(c["corr_1"]) >= least * 0.7) & (F.abs(c["corr_2"]) >= least * 0.7)


def with_stability(lags: DataFrame, least: float = 0.3, tolerance: int = 2) -> DataFrame:
    """Adds stable: both halves have the same sign, a lag within the tolerance and 0.7 of the least correlation."""
    return lags.withColumn("stable", is_stable({c: F.col(c) for c in lags.columns}, least, tolerance))


def kept_correlations(lags: DataFrame, least: float = 0.3, count: int = 3) -> DataFrame:
    """The `count` greatest correlations of each window at or above `least`: rank from 0, var, corr, lag, relation, stable."""
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.abs("corr")), "var")
    kept = lags.where(F.abs("corr") >= least).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < count)
    return kept.select(*KEY, "rank", "var", "corr", "lag", F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("relation"), "stable")
