"""Two-level scans: running values along a series whose points are spread over many tasks.

A series is cut into buckets of consecutive places. Tasks work within buckets; what passes from one bucket to the next
(counts, last known values) is one row a bucket, and only those rows meet by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket, or seconds of a bucket where points are ordered by time.
PLACES, SECONDS = 1 << 16, 86_400
BUCKET = "_bucket"
#: About as many points as one task sorts.
TASK_POINTS = 1 << 18


def dealt(points: DataFrame, keys: list[str], count: int) -> DataFrame:
    """`points`, `count` rows, by their keys to so many tasks that each sorts about TASK_POINTS; as they are if Spark's
    own number of tasks will do. Window functions and groups over the keys need no further exchange."""
    parts = -(-count // TASK_POINTS)
    return points.repartition(parts, *keys) if parts > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) else points


def bucketed(points: DataFrame, order: str = "t") -> DataFrame:
    """Adds the bucket of each point: of PLACES numbers, or of a day for timestamps and dates."""
    kind = dict(points.dtypes)[order]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return points.withColumn(BUCKET, F.floor(F.col(order).cast("timestamp").cast("double") / SECONDS).cast("long"))
    if kind == "string" or kind.startswith(("array", "struct", "map", "bool", "binary")):
        return points.withColumn(BUCKET, F.lit(0).cast("long"))
    return points.withColumn(BUCKET, F.floor(F.col(order) / F.lit(PLACES)).cast("long"))


def joined(points: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """`points` with the columns of `known`, which has one row for each key and bucket; null keys are equal."""
    on = [*keys, BUCKET]
    other = known.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in known.columns if c not in on])
    met = points.join(other, [points[k].eqNullSafe(other[f"_k_{k}"]) for k in on])
    return met.drop(*[f"_k_{k}" for k in on])


def with_size(points: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the number of the series' points, without bringing a series together."""
    cut = bucketed(points, order)
    each = cut.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n"))
    total = each.withColumn(name, F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    return joined(cut, total, keys).drop(BUCKET)


def numbered(points: DataFrame, keys: list[str], order: list[str], name: str = "t") -> DataFrame:
    """Adds the place of each point in its series, from 0, in the order of the columns `order`; the first of them cuts
    the series into buckets."""
    cut = bucketed(points, order[0])
    each = cut.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = each.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)) - 1
    return joined(cut.withColumn("_in", inside), base, keys).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in", BUCKET)


def last_and_next(points: DataFrame, keys: list[str], order: str, value: str) -> tuple[DataFrame, Column, Column]:
    """`points` with what is needed, the last known value at or before each point, and the next known one at or after."""
    cut = bucketed(points, order)
    inner = Window.partitionBy(*keys, BUCKET).orderBy(order)
    near = cut.withColumn("_before", F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_after", F.first(value, ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing)))
    # a bucket's first and last known value, by the rows' own order: any row's "after" at the front, "before" at the end
    known = F.col(value).isNotNull()
    ends = cut.groupBy(*keys, BUCKET).agg(F.min_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_first"), F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_last"))
    along = Window.partitionBy(*keys).orderBy(BUCKET)
    ends = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_coming", F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))).drop("_first", "_last")
    return joined(near, ends, keys), F.coalesce("_before", "_carried"), F.coalesce("_after", "_coming")
