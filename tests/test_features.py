"""Small hand-computed series and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import kernels as k
from seriesloom.operators import claims as c
from seriesloom.operators import clean, events, features
from seriesloom.operators.labels import label_points
from seriesloom.operators.windows import sliding_windows, window_arrays


def points(spark, **series):
    rows = [(key, t, float(v) if v is not None else None) for key, vs in series.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_key string, t long, value double")


def whole(spark, **series):
    return sliding_windows(points(spark, **series), 0)


def one(df, column, **where):
    for name, value in where.items():
        df = df.where(F.col(name) == value)
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 127, 128, 129, 200])
def test_window_counts(spark, n):
    got = sliding_windows(points(spark, a=range(n)), 20, 8).where("i = 0").count()
    assert got == (1 if n < 20 else (n - 20) // 8 + 1)


def test_constant_series(spark):
    w = whole(spark, a=[5.0] * 40)
    assert set(one(features.with_z(w), "z")) == {0.0}
    assert one(features.global_trend(features.trend_segments(w)), "trend") == ["flat"]
    assert one(features.volatility_label(w), "volatility") == ["low"]
    assert events.extrema(w).count() == 0
    assert events.ramps(w).count() == 0
    assert one(events.slope_segments(w), "label") == [0]


def test_linear_ramp(spark):
    w = whole(spark, up=range(60), down=range(60, 0, -1))
    trend = features.global_trend(features.trend_segments(w))
    assert one(trend, "trend", series_key="up") == ["up"] and one(trend, "trend", series_key="down") == ["down"]
    ramps = {r.series_key: (r.kind, r.start, r.end) for r in events.ramps(w).collect()}
    assert ramps == {"up": ("ramp_up", 0, 59), "down": ("ramp_down", 0, 59)}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_very_short_windows(spark, n):
    w = whole(spark, a=[float(i * i) for i in range(n)])
    for df in (features.trend_segments(w), features.net_change(w), features.volatility_label(w), features.amplitude(w), events.slope_segments(w), features.series_stats(points(spark, a=range(n)), ["series_key"])):
        df.collect()
    assert c.build_claims(w).count() >= 3


def test_impulse_and_thinning(spark):
    x = [0.0] * 30
    x[10], x[13], x[20] = 9.0, 8.0, 10.0
    w = whole(spark, a=x)
    assert sorted(one(events.extrema(w), "i")) == [10, 13, 20]
    assert sorted(one(events.thin(events.extrema(w)), "i")) == [10, 20]
    assert one(events.argmax_position(w), "place") == [21]


def test_fill_policies(spark):
    p = points(spark, a=[None, 1.0, None, 3.0, None], b=[None, None])
    got = {(r.series_key, r.t): r.value for r in clean.fill_series(p, ["series_key"]).collect()}
    assert [got["a", i] for i in range(5)] == [1.0, 1.0, 1.0, 3.0, 3.0] and got["b", 0] == 0.0
    assert clean.fill_series(p, ["series_key"], policy="drop").count() == 2
    arr = spark.createDataFrame([([math.nan, 1.0, None, 3.0],)], "v array<double>").select(clean.fill_array(F.col("v")).alias("v"))
    assert arr.first().v == [1.0, 1.0, 1.0, 3.0]


def test_overlapping_intervals_label_once(spark):
    p = spark.sql("SELECT 'a' AS series_key, id AS t, timestamp'2024-01-01' + make_interval(0,0,0,0,id,0,0) AS ts FROM range(48)")
    iv = spark.sql("SELECT 'a' AS series_key, timestamp'2024-01-01 02:00:00' AS a, timestamp'2024-01-01 05:00:00' AS b UNION ALL SELECT 'a', timestamp'2024-01-01 04:00:00', timestamp'2024-01-02 01:00:00'")
    got = label_points(p, iv, ["series_key", "t"])
    assert got.count() == 48
    assert sorted(one(got, "t", label=1)) == list(range(2, 26))


def test_periods():
    x = np.sin(2 * np.pi * np.arange(120) / 12)
    assert k.acf_of(x)[:2] == (True, 12)
    assert k.spectrum_of(x)[0] == 12
    assert k.acf_of([1.0] * 30) == (False, None, 0.0)
    assert k.spectrum_of([1.0] * 5) == (None, 0.0)


@pytest.mark.parametrize("lag", [5, -5])
def test_lag_sign(lag):
    rng = np.random.default_rng(3)
    base = rng.normal(size=140)
    y, x = base[20:120], base[20 + lag : 120 + lag]
    corr, at = k.best_cosine(y, x[:, None], 24)
    assert at[0] == lag and corr[0] > 0.9


def test_rouge_matches_table():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (list("abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 30))) for _ in range(2))
        assert k.rouge_l_of(" ".join(a), " ".join(b)) == pytest.approx(slow(a, b))


def test_mmr_keeps_strongest_and_spreads():
    spans = [(0, 9, 10.0), (10, 19, 9.0), (20, 29, 8.5), (90, 99, 5.0)]
    assert k.mmr_of(spans, k=2) == [0, 3] or 0 in k.mmr_of(spans, k=2)
    assert k.mmr_of([]) == []


def test_untouched_claims_validate(spark):
    rng = np.random.default_rng(5)
    w = whole(spark, a=rng.normal(size=128).cumsum(), b=rng.normal(size=128))
    checked = c.validate_claims(c.build_claims(w), w).where("type <> 'seasonality'")
    assert checked.where(~F.col("ok")).count() == 0


def test_kernel_matches_window_form(spark):
    rng = np.random.default_rng(6)
    w = whole(spark, a=rng.normal(size=100))
    arr = window_arrays(w, ["value"]).first().value
    dl = window_arrays(w, ["value"]).select(k.dominant_lag("value").alias("p")).first().p
    y = np.array(arr) - np.mean(arr)
    acf = [y[j:] @ y[:-j] / (y @ y) for j in range(1, 51)]
    assert dl.lag == int(np.argmax(acf)) + 1


def test_sql_kernels(spark):
    k.register(spark)
    assert spark.sql("SELECT rouge_l('a b c', 'a c') AS r").first().r == pytest.approx(0.8)


def test_transpose_query_takes_every_series(spark, tmp_path):
    """Five suppliers, one of them with two windows, against windows built by hand."""
    from datetime import datetime, timedelta

    from seriesloom.plans.q_data import p16

    sizes = {1: 3, 2: 1, 5: 2, 7: 130, 9: 192}
    rows = [(o, 1, 1, s, datetime(2020, 1, 1) + timedelta(days=o), float(o % 7), s * 1000.0 + o, 0.0, 0.0) for s, n in sizes.items() for o in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for s, n in sizes.items():
        for w in range(0, max(n - 128, 0) + 1, 64):
            for i in range(min(n, 128)):
                want += [(s, w, 0, i, s * 1000.0 + w + i), (s, w, 1, i, float((w + i) % 7))]
    assert sorted(tuple(r) for r in p16(spark, str(tmp_path)).collect()) == sorted(want)


def test_span_queries_search_as_the_reference(spark, tmp_path, monkeypatch):
    """A span of n places has n - 1 shorter ones of at least its mean (one side of each cut), so the length of the
    search shows in its candidates, not in the best 5."""
    from seriesloom.plans import q_eval

    rng = np.random.default_rng(5)
    vectors = [(i, 0, [float(x) for x in rng.integers(0, 3, 64)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lengths, own = [], q_eval.r.top_spans
    monkeypatch.setattr(q_eval.r, "top_spans", lambda scores, most, count: lengths.append((most, count)) or own(scores, most, count))
    got = sorted((x.id, x.rank, x.start, x.end, x.score) for x in q_eval.r7(spark, str(tmp_path)).collect())
    want = []
    for i, _, v in vectors:
        spans = [(a, b, round(sum(v[a:b]) / (b - a), 12)) for a in range(64) for b in range(a + 1, min(a + 32, 64) + 1)]
        best = sorted(spans, key=lambda x: (-x[2], x[1] - x[0], x[0]))[:5]
        want += [(i, k + 1, a, b, round(m, 9)) for k, (a, b, m) in enumerate(best)]
    assert got == want
    assert q_eval.r9(spark, str(tmp_path)).collect()[0].queries == 60
    q_eval.r11(spark, str(tmp_path))
    assert lengths == [(32, 5), (32, 5), (32, 1)]


def test_corpus_grounding_query_takes_fifty_series(spark, tmp_path):
    from seriesloom.plans.q_eval import r11

    vec = np.random.default_rng(6).normal(size=(600, 8))
    spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(vec)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    mean = vec.reshape(60, 10, 8).mean(axis=1)
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    want = []
    for q in range(0, 600, 100):
        near = np.argsort(-(mean @ vec[q]))[:50]
        best = sorted(((vec[10 * s : 10 * s + 10] @ vec[q]).max(), s) for s in near)[::-1][:5]
        want += [(q, int(s), k + 1, pytest.approx(m, abs=1e-8)) for k, (m, s) in enumerate(best)]
    assert sorted((x.id, x.series, x.rank, x.score) for x in r11(spark, str(tmp_path)).orderBy("id", "rank").collect()) == sorted(want, key=lambda x: x[:3][:2])


def test_wide_csv_judges_columns_by_all_rows(spark, tmp_path):
    """A first cell of text after row 100, or in another file, leaves the column out; missing values do not."""
    from seriesloom.sources.readers import read_wide_csv

    def cells(i):
        return [f"d{i}", i, "late" if i == 150 else i, "NA" if i == 180 else f" {i}.5 ", "" if i > 90 else "-1e3", "true" if i == 399 else "1"]

    for part in range(2):
        (tmp_path / f"{part}.csv").write_text("date,a, b ,c.x,d,e\n" + "".join(",".join(map(str, cells(i))) + "\n" for i in range(200 * part, 200 * part + 200)))
    got = read_wide_csv(spark, str(tmp_path))
    assert got.columns == ["date", "a", "c.x", "d"]
    rows = {r[0]: r[1:] for r in got.collect()}
    assert rows == {f"d{i}": (float(i), None if i == 180 else i + 0.5, None if i > 90 else -1000.0) for i in range(400)}
    assert read_wide_csv(spark, str(tmp_path), series_cols=["b"]).where("b is null").count() == 1


def test_stream_arrivals_are_spread_by_series(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from seriesloom.plans import q_files

    rows = [(i, i % 40, datetime(2024, 1, 1) + timedelta(hours=i), "view", float(i), "{}") for i in range(40 * 70)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    arrivals, own = [], q_files.stream_records

    def seen(session, folder, *rest):
        files = session.read.parquet(folder).select("series_key", F.col("_metadata.file_name").alias("f")).distinct().collect()
        arrivals.append((len({r.f for r in files}), len(files), len({r.series_key for r in files})))
        own(session, folder, *rest)

    monkeypatch.setattr(q_files, "stream_records", seen)
    got = sorted((int(r.series_key), r.w_start, r.w_end) for r in q_files.y1(spark, str(tmp_path)).collect())
    assert got == [(k, w, w + 31) for k in range(40) for w in (0, 16, 32)]
    assert [a[1:] for a in arrivals] == [(20, 20), (40, 40)]  # each series whole in one file
    assert arrivals[0][0] > 1


def test_thinned_phases_of_every_number(spark):
    from seriesloom.operators.render import thinned_phases

    rows = [(n, 0, p) for n in range(1, 13) for p in range(n)]
    kept = {}
    for r in thinned_phases(spark.createDataFrame(rows, "series_key long, w_start long, phase int")).collect():
        kept.setdefault(r.series_key, []).append(r.phase)
    for n in range(1, 13):
        middle = list(range(2, n - 2))
        want = list(range(n)) if n <= 5 else [0, 1, *middle[:: max(1, len(middle) // 2)], n - 2, n - 1]
        assert sorted(kept[n]) == want


def test_phase_forms(spark):
    """Dip before spike, bounds of 1.5 spans or 5 % of the start, labels of the phase before, null ends."""
    from seriesloom.operators.render import phase_forms

    rows = [
        (0, "up", 10.0, 12.0, 9.5, 15.0), (1, "up", 10.0, 12.0, 9.5, 15.1), (2, "up", 10.0, 12.0, 6.9, 15.1), (3, "up", 10.0, 12.0, 10.0, 12.0), (4, "flat", 100.0, 100.0, 95.0, 105.0), (5, "flat", 100.0, 100.0, 95.0, 105.1),
        (6, "flat", None, 100.0, 0.0, 900.0), (7, None, 1.0, 1.0, 1.0, 1.0), (8, None, 1.0, 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "series_key long, w_start long, phase int, label string, start_v double, end_v double, min_v double, max_v double")
    got = [r.form for r in phase_forms(df).orderBy("phase").collect()]
    assert got == ["plain", "spike", "dip", "continue", "plain", "spike", "continue", "plain", "plain"]


def test_shards_are_named_after_their_data_sets(spark, tmp_path):
    from seriesloom.sources.readers import read_shards

    for name in ("ucr_ECG_train.jsonl", "ucr_my_ucr_set_train.jsonl", "Wine.jsonl"):
        (tmp_path / name).write_text('{"series_key": "%s"}\n' % name)
    got = {r.series_key: r.source_dataset for r in read_shards(spark, f"{tmp_path}/*.jsonl").collect()}
    assert got == {"ucr_ECG_train.jsonl": "ECG", "ucr_my_ucr_set_train.jsonl": "my_set", "Wine.jsonl": "Wine.jsonl"}


def test_counts_of_fine_tuning_rows(spark):
    from seriesloom.operators.tables import sft_counts

    records = spark.createDataFrame([(True,), (False,), (None,)], "pass boolean").selectExpr("struct(pass) AS claim_check")
    assert tuple(sft_counts(records, spark.range(5)).first()) == (3, 5, 2)
    assert tuple(sft_counts(records.limit(0), spark.range(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("n", [1, 7, 8, 20, 41, 64, 90, 1025, 1400])
def test_lag_sums_match_slices(n):
    """Random, shifted, constant and partly unknown columns against slices compared one by one."""
    rng = np.random.default_rng(n)
    for case in range(12):
        y, x = rng.normal(size=n) * 10.0 ** rng.integers(-3, 6) + 1e5, rng.normal(size=(n, 3)) + rng.integers(0, 1000)
        y[: n // 2 if case % 3 == 0 else 0] = 7.0
        x[n // 3 if case % 4 == 0 else n :, 0], x[: n if case % 5 == 0 else 0, 1] = 5.0, 3.0
        x[n // 2 if case % 6 == 0 else n : n // 2 + 1, 2] = np.nan
        corr, at = k.best_pearsons(y, x, 24)
        for j in range(3):
            assert (corr[j], at[j]) == pytest.approx(k.best_pearson(y, x[:, j], 24), abs=1e-9)
        if n < 20:
            continue
        zy, zx = ((v - v.mean(axis=0)) / (v.std(axis=0) + 1e-9) for v in (y, x[:, :2]))
        pairs = [(lag, *((zy[lag:], zx[: n - lag]) if lag >= 0 else (zy[:lag], zx[-lag:]))) for lag in range(-24, 25) if n - abs(lag) >= 8]
        cosines = np.array([b.T @ a / (np.linalg.norm(b, axis=0) * np.linalg.norm(a) + 1e-9) for _, a, b in pairs])
        got, _ = k.best_cosine(y, x[:, :2], 24)
        assert np.abs(got) == pytest.approx(np.abs(cosines).max(axis=0), abs=1e-9)
