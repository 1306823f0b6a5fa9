"""Claims from one row a window: the events are those of the window functions, and points meet once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import kernels
from seriesloom.operators import claims as c
from seriesloom.operators import events
from seriesloom.operators.features import window_features
from seriesloom.operators.windows import KEY, sliding_windows
from seriesloom.sources import scratch


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(11)
    series = {f"w{k}": np.cumsum(rng.normal(size=int(n))) for k, n in enumerate(rng.integers(1, 140, 25))}
    series |= {f"n{k}": rng.normal(size=k) for k in range(1, 8)} | {f"r{k}": rng.normal(size=90) * 50 for k in range(5)}
    series |= {"flat": np.full(60, 3.0), "line": np.arange(80.0), "saw": np.abs(np.arange(120) % 60 - 30.0)}
    rows = [(k, i, float(v), float(i % 7)) for k, own in series.items() for i, v in enumerate(own)]
    return sliding_windows(spark.createDataFrame(rows, "series_key string, t long, value double, other double"), 0).cache()


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_events_of_rows_are_those_of_points(windows):
    own = events.with_events(window_features(windows)).cache()
    part = lambda name: own.select(*KEY, F.posexplode(name).alias("rank", "e"))
    tops = events.top_events(events.thin(events.extrema(windows)))
    for kind, name in (("peak", "peaks"), ("valley", "valleys")):
        assert rows(part(name).select(*KEY, "rank", "e.i", "e.z", "e.value", "e.delta_pct")) == rows(tops.where(F.col("kind") == kind).select(*KEY, "rank", "i", "z", "value", "delta_pct"))
    columns = ["kind", "start", "end", "delta_pct"]
    assert rows(part("ramps").select(*KEY, "rank", *[f"e.{x}" for x in columns])) == rows(events.ramps(windows).select(*KEY, "rank", *columns))
    columns = ["phase", "start", "end", "label", "start_v", "end_v", "delta_pct", "min_v", "max_v", "std"]
    assert rows(part("phases").select(*KEY, *[f"e.{x}" for x in columns])) == rows(events.phases(windows).select(*KEY, *columns))


def test_points_meet_once_and_nothing_is_stored(spark, windows):
    before = len(scratch._made.get(spark.sparkContext.applicationId, []))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    built = c.build_claims(windows, ["other"])
    assert len(scratch._made.get(spark.sparkContext.applicationId, [])) == before
    assert exchanges(built) - exchanges(windows.select("*")) <= 1


def test_kernels_of_many_windows_are_those_of_one():
    rng = np.random.default_rng(12)
    for n in (6, 7, 11, 20, 41, 128):
        x = np.concatenate([rng.normal(size=(6, n)), np.full((1, n), 2.0), np.sin(np.arange(n) / 3)[None], np.arange(n)[None]])
        same = lambda a, b: a == b or np.allclose(np.array(a, float), np.array(b, float), equal_nan=True)
        assert all(same(a, kernels.acf_of(row, n // 2)) for a, row in zip(kernels.acf_rows(x, n // 2), x, strict=True))
        assert all(same(a, kernels.spectrum_of(row)) for a, row in zip(kernels.spectrum_rows(x), x, strict=True))
        others = rng.integers(0, 4, (len(x), 2, n)).astype(float)
        for many, one in ((kernels.cosine_rows, kernels.best_cosine), (kernels.pearson_rows, kernels.best_pearsons)):
            corr, lag = many(x, others, 24)
            for k, (y, other) in enumerate(zip(x, others, strict=True)):
                a, b = one(y, other.T, 24)
                assert np.allclose(corr[k], a) and (lag[k] == b).all()


def test_records_are_made_within_rows(windows):
    """Checked claims and segments as the operators on claims give them."""
    known = window_features(windows, ["other"], check=True).cache()
    made = c.checked_claims(c.with_claims(known, ["other"]), ["other"]).cache()
    checked = c.validate_claims(c.build_claims(windows, ["other"], known).cache(), windows, ["other"], known).cache()
    final = c.apply_policy(c.amplitude_note(c.repair_trend(checked))).cache()
    columns = ["ord", "id", "type", "start", "end", "idx", *c.DATA, "ok", "reason"]
    assert rows(made.select(*KEY, F.inline_outer("claims")).select(*KEY, *columns)) == rows(final.select(*KEY, *columns))
    assert rows(made.select(*KEY, F.posexplode("claims"), "pass", "n_failed").select(*KEY, "pass", "n_failed").distinct()) == rows(c.claim_check(checked).select(*KEY, "pass", "n_failed"))
    segments = c.with_segments(made).select(*KEY, F.posexplode("segments").alias("segment_id", "s")).select(*KEY, "segment_id", "s.type", "s.start", "s.end")
    assert rows(segments) == rows(c.target_segments(final))
