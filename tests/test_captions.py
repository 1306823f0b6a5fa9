"""Caption matching, groups, BLEU counts against brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from seriesloom.functions.kernels import clipped_of
from seriesloom.operators import labels, texteval


def near(a, b, rtol=1e-5, atol=1e-8):
    return len(a) == len(b) and all(len(x) == len(y) and all(abs(p - q) <= atol + rtol * abs(q) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_matches_of_repeated_and_nearly_equal_series(spark):
    rng = np.random.default_rng(3)
    kinds = [[[0.0] * 12], [[5.0] * 12], [[5.0] * 13], [[5.0] * 12, [1.0] * 12], [[0.0] * 11 + [1e-9]], [[0.0] * 11 + [3.0]], [[-2.0] * 12]]
    kinds += [[rng.normal(size=20).tolist()] for _ in range(6)]
    captions = [(i, kinds[k % len(kinds)], f"text {i}", "x") for i, k in enumerate(rng.integers(0, 40, 80).tolist())]
    questions = [(i, [[v * (1 + 2e-6 * (i % 3 - 1)) for v in row] for row in kinds[k % len(kinds)]], -1) for i, k in enumerate(rng.integers(0, 40, 120).tolist())]
    questions += [(200, [[7.25] * 12], -1), (201, [[]], -1)]
    q = spark.createDataFrame(questions, "question_id long, series array<array<double>>, _part int")
    c = spark.createDataFrame(captions, "caption_id long, series array<array<double>>, text string, other string")
    got = {r.question_id: (r.caption_id, r.text) for r in labels.match_captions(q.drop("_part"), c).collect()}
    same_key = lambda a, b: [round(x, 4) for x in a[0][:10]] == [round(x, 4) for x in b[0][:10]]
    for i, series, _ in questions:
        want = [(j, t) for j, s, t, _ in captions if s[0] and same_key(series, s) and near(series, s)]
        assert got[i] == (min(want) if want else (None, None))
    assert len(got) == len(questions)


def test_magnitudes_of_near_series_are_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = []
    for scale in (1e-12, 1e-6, 1.0, 1e7):
        for _ in range(50):
            b = rng.normal(size=30) * scale
            a = b + (1e-8 + 1e-5 * np.abs(b)) * rng.uniform(-1, 1, 30)
            rows.append(([a.tolist()], [b.tolist()]))
    df = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>")
    assert df.where(F.abs(labels._magnitude(df.a, 1e-5, 1e-8) - labels._magnitude(df.b, 1e-5, 1e-8)) > 1).count() == 0


def test_groups_leave_no_pairs(spark):
    captions = spark.createDataFrame([(i, i % 3) for i in range(30)], "caption int, group_key int")
    samples = spark.createDataFrame([(i, i % 2) for i in range(40)], "sample_id int, group_key int")
    assert sorted(tuple(r) for r in labels.caption_groups(captions, samples).collect()) == [(0, 20, 10), (1, 20, 10)]
    batches = [(i // 10, i, i % 4) for i in range(40)]
    got = {r.sample_id: r.positives for r in labels.batch_positives(spark.createDataFrame(batches, "batch int, sample_id int, group_key int")).collect()}
    own = defaultdict(list)
    for b, i, g in batches:
        own[b, g].append(i)
    assert got == {i: own[b, g] for b, i, g in batches}


def test_members_give_back_all_pairs(spark):
    captions = [(i, i % 3) for i in range(30)]
    samples = [(i, i % 2) for i in range(40)]
    rows = labels.caption_members(spark.createDataFrame(captions, "caption int, group_key int"), spark.createDataFrame(samples, "sample_id int, group_key int")).collect()
    assert sorted((r.id, r.group_key) for r in rows if r.side == "caption") == captions
    assert sorted((r.id, r.group_key) for r in rows if r.side == "sample") == samples
    pairs = [(c, s) for c, g in captions for s, h in samples if g == h]
    assert [r.positives for r in sorted(rows, key=lambda r: r.id) if r.side == "caption"] == [sum(c == i for c, _ in pairs) for i in range(30)]
    assert [r.positives for r in sorted(rows, key=lambda r: r.id) if r.side == "sample"] == [sum(s == i for _, s in pairs) for i in range(40)]


def test_clipped_counts(spark):
    rng = random.Random(1)
    pairs = [(str(i), *(" ".join(rng.choice("a b c d e !".split()) for _ in range(rng.randint(0, 30))) for _ in range(2))) for i in range(60)] + [("n", None, "a b"), ("m", "a", None)]
    want = Counter()
    for _, r, h in pairs:
        r, h = (r or "").split(), (h or "").split()
        for n in range(1, 5):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (r, h))
            want[n, "m"] += sum(min(c, a[g]) for g, c in b.items())
            want[n, "t"] += sum(b.values())
        assert clipped_of(r, h)[4:] == [max(len(h) - n + 1, 0) for n in range(1, 5)]
    got = texteval.bleu_counts(spark.createDataFrame(pairs, "id string, ref string, hyp string")).collect()
    assert {r.n: (r.matched, r.total) for r in got} == {n: (want[n, "m"], want[n, "t"]) for n in range(1, 5)}
    assert texteval.bleu_counts(spark.createDataFrame([], "id string, ref string, hyp string")).count() == 0


def test_long_intervals_cost_few_rows(spark):
    begin = datetime(2020, 1, 1)
    spans = [("a", begin, begin + timedelta(days=3)), ("a", begin + timedelta(days=10), datetime(9999, 1, 1)), ("b", datetime(1900, 1, 1), begin + timedelta(days=5)), ("b", begin + timedelta(days=300), begin + timedelta(days=400)), ("c", begin, begin - timedelta(days=1)), (None, begin, begin)]
    intervals = spark.createDataFrame(spans, "series_key string, a timestamp, b timestamp")
    assert labels._cut(intervals, 86_400).count() < 200
    rows = [(k, t, begin + timedelta(hours=6 * t)) for k in ("a", "b", "c") for t in range(0, 2000, 3)] + [(None, 0, begin), ("a", -1, None)]
    got = labels.label_points(spark.createDataFrame(rows, "series_key string, t int, ts timestamp"), intervals, ["series_key", "t"]).collect()
    want = {(k, t): int(any(k == s and ts is not None and a <= ts <= b for s, a, b in spans if s)) for k, t, ts in rows}
    assert {(r.series_key, r.t): r.label for r in got} == want and len(got) == len(rows)
