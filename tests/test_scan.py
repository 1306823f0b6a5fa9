"""Scans over buckets of long series."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clean, scan
from seriesloom.operators.windows import sliding_windows


@pytest.fixture(params=[3, 1 << 16])
def places(request, monkeypatch):
    monkeypatch.setattr(scan, "PLACES", request.param)


def rows(seed):
    rng = random.Random(seed)
    out = []
    for key in ("a", "b", None, "gaps", "one"):
        n = 1 if key == "one" else rng.randint(5, 40)
        out += [(key, t, None if key == "gaps" or rng.random() < 0.4 else rng.choice([1.5, float(t), float("nan")])) for t in range(n)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fill_over_buckets(spark, places, seed):
    data = rows(seed)
    got = clean.fill_series(spark.createDataFrame(data, "series_key string, t long, value double").repartition(5), ["series_key"]).collect()
    want = {}
    for key in {k for k, _, _ in data}:
        own = [(t, v if v == v else None) for k, t, v in sorted((x for x in data if x[0] == key), key=lambda x: x[1])]
        known = [v for _, v in own if v is not None]
        last = None
        for t, v in own:
            last = v if v is not None else last
            want[key, t] = last if last is not None else known[0] if known else 0.0
    assert {(r.series_key, r.t): r.value for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("length,stride", [(4, 2), (7, 7), (0, 1), (100, 3)])
def test_windows_over_buckets(spark, places, length, stride):
    data = [(k, t, float(t)) for k, n in (("a", 23), ("b", 3), (None, 9)) for t in range(n)]
    got = sliding_windows(spark.createDataFrame(data, "series_key string, t long, value double").repartition(3), length, stride).collect()
    want = set()
    for k, n in (("a", 23), ("b", 3), (None, 9)):
        starts = [0] if length <= 0 or n < length else range(0, n - length + 1, stride)
        size = n if length <= 0 or n < length else length
        want |= {(k, s, s + size - 1, size, t - s, t) for s in starts for t in range(s, s + size)}
    assert {(r.series_key, r.w_start, r.w_end, r.n, r.i, r.t) for r in got} == want and len(got) == len(want)


def test_numbering_by_time(spark):
    data = [("a", i * 50_000, i % 7) for i in range(40)] + [("b", 5, 0), (None, 1, 1), (None, 0, 2)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "series_key string, at long, extra int").withColumn("ts", F.timestamp_seconds("at"))
    got = scan.numbered(df, ["series_key"], ["ts", "extra"]).collect()
    for key in ("a", "b", None):
        own = sorted((r.at, r.t) for r in got if r.series_key == key)
        assert [t for _, t in own] == list(range(len(own)))
    assert len(got) == len(data)


def test_one_long_series_is_spread(spark):
    """Counting and filling one series of 300,000 points: no task reads more than a bucket or two."""
    points = spark.range(300_000, numPartitions=6).select(F.lit("x").alias("series_key"), F.col("id").alias("t"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("value"))
    filled = clean.fill_series(points, ["series_key"])
    assert filled.where("value <> t - t % 10").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = filled.select("t").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 300_000
