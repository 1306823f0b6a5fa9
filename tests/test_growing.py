"""Series that arrive piece by piece."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.sources.readers import read_records
from seriesloom.streaming.incremental import POINTS, stream_records


@pytest.mark.parametrize("length,stride", [(5, 2), (4, 6)])
def test_cut_series_give_the_batch_windows(spark, tmp_path, length, stride):
    rng = random.Random(length)
    sizes = {"a": 31, "b": 5, "c": 3, "late": 12, None: 9}
    begin = datetime(2024, 1, 1)
    rows = [(k, t, begin + timedelta(hours=t), None if t == 7 else float(t)) for k, n in sizes.items() for t in range(n)]
    cuts = {k: sorted(rng.randint(0, n) for _ in range(2)) for k, n in sizes.items()}
    arrivals = [[r for r in rows if (r[1] >= cuts[r[0]][0]) + (r[1] >= cuts[r[0]][1]) == part and r[0] != "late"] for part in range(3)]
    arrivals[0] += [r for r in rows if r[0] == "late" and r[1] >= 2]
    arrivals[1] += [("late", 5, begin, -1.0), ("late", 0, begin, 0.0)]  # at or before what came: left out

    def build(win):
        spans = win.groupBy("series_key", "w_start", "w_end").agg(F.array(F.sort_array(F.collect_list(F.coalesce("value", F.lit(-9.0))))).alias("timeseries"))
        return spans.select(F.lit("d").alias("dataset"), "series_key", F.array("w_start", "w_end").cast("array<int>").alias("indices"), "timeseries")

    for own in arrivals:
        rng.shuffle(own)
        spark.createDataFrame(own, POINTS).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream_records(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", build, length, stride, growing=True)
    got = sorted((str(r.series_key), *r.indices, tuple(r.timeseries[0])) for r in read_records(spark, f"{tmp_path}/out").collect())
    want = []
    for k, n in sizes.items():
        for w in range(0, n - length + 1, stride):
            span = [t for t in range(w, w + length) if k != "late" or t >= 2]
            want.append((str(k), w, w + length - 1, tuple(sorted(-9.0 if t == 7 else float(t) for t in span))))
    assert got == sorted(want)
