"""Searches over metric indexes against brute force."""

import numpy as np
import pytest

from seriesloom.operators import retrieval, vectors
from seriesloom.sources import scratch


def table(spark, ids, groups, m):
    rows = [(int(i), g, None if v is None else [float(x) for x in v], "x", 1.0) for i, g, v in zip(ids, groups, m, strict=True)]
    kind = "string" if any(isinstance(g, str) for g in groups) else "long"
    return spark.createDataFrame(rows, f"id long, group_key {kind}, vec array<double>, block string, rank double")


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def cloud(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "copies":
        return rng.normal(size=(5, 6))[rng.integers(0, 5, n)]
    if kind == "clustered":
        return rng.normal(size=(8, 6))[rng.integers(0, 8, n)] + 0.03 * rng.normal(size=(n, 6))
    return rng.normal(size=(n, 6))


@pytest.fixture(params=[1024, 16])
def block(request, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", request.param)
    return request.param


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
@pytest.mark.parametrize("groups", [3, 60, "names"])
def test_ranks(spark, block, kind, groups):
    qm, cm = cloud(kind, 90, 1), cloud(kind, 130, 1 if kind == "copies" else 2)
    rng = np.random.default_rng(3)
    number = 4 if groups == "names" else groups
    qg, cg = rng.integers(0, number, 90).tolist(), rng.integers(0, number, 130).tolist()
    qg[0] = number + 5  # no positive at all
    if groups == "names":
        qg, cg = [f"g{x}" for x in qg], [f"g{x}" for x in cg]
    qi, ci = rng.permutation(500)[:90], rng.permutation(500)[:130]
    got = {r.id: r["rank"] for r in retrieval.first_positive_rank(table(spark, qi, qg, qm), table(spark, ci, cg, cm)).collect()}
    sim = np.round(unit(qm) @ unit(cm).T, 11)
    for k in range(90):
        order = sorted(range(130), key=lambda j: (-sim[k, j], ci[j]))
        want = next((n for n, j in enumerate(order, 1) if cg[j] == qg[k]), 131)
        assert got[int(qi[k])] == want


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
@pytest.mark.parametrize("by_group", [False, True])
def test_short_lists(spark, block, kind, by_group):
    qm, cm = cloud(kind, 70, 4), cloud(kind, 160, 4)
    ids, series = np.arange(160) * 3, np.arange(160) // 7
    find = retrieval.best_patch_shortlist if by_group else retrieval.shortlist
    name = "series" if by_group else "candidate"
    got = {}
    for r in find(table(spark, range(70), [0] * 70, qm), table(spark, ids, series.tolist(), cm), 9).collect():
        got.setdefault(r.id, []).append((r["rank"], r[name], r.sim))
    sim = unit(qm) @ unit(cm).T
    for k in range(70):
        best = [(sim[k][series == s].max(), s) for s in np.unique(series)] if by_group else list(zip(sim[k], ids, strict=True))
        want = sorted((m for m, _ in best), reverse=True)[:9]
        own = sorted(got[k])
        assert [r for r, _, _ in own] == list(range(1, 10)) and [s for _, _, s in own] == pytest.approx(want, abs=1e-9)
        of = {n: m for m, n in best}
        assert all(of[n] == pytest.approx(s, abs=1e-9) for _, n, s in own) and len({n for _, n, _ in own}) == 9


def test_bounds_spare_blocks(spark, monkeypatch):
    """Well separated cells: most pairs of blocks are settled by their bounds, and the ranks do not change."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(9)
    heart = np.eye(12)[rng.integers(0, 12, 1200)]
    m = heart + 0.01 * rng.normal(size=(1200, 12))
    groups = heart.argmax(axis=1).tolist()
    rows = table(spark, range(1200), groups, m)
    left = vectors.metric_index(rows.selectExpr("id", "group_key", "vec", "0.99D as sim", "0L as at"))
    kinds = {r.kind: r["count"] for r in retrieval.rank_pairs(left, vectors.metric_index(rows)).groupBy("kind").count().collect()}
    assert kinds["look"] < 0.3 * sum(kinds.values())
    got = {r.id: r["rank"] for r in retrieval.first_positive_rank(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).collect()}
    assert set(got.values()) == {1}


def test_index_of_none_and_nulls(spark):
    none = spark.createDataFrame([], "id long, group_key long, vec array<double>")
    some = table(spark, [1, 2, 3], [0, 0, 1], [[1.0, 0.0], None, [0.0, 0.0]])
    assert vectors.metric_index(none).count() == 0
    assert retrieval.shortlist(some, none, 3).count() == 0 and retrieval.shortlist(none, some, 3).count() == 0
    assert {r.id: r["rank"] for r in retrieval.first_positive_rank(some, some).collect()} == {1: 1, 2: 4, 3: 2}
    assert {r.id: r["rank"] for r in retrieval.first_positive_rank(some, none).collect()} == {1: 1, 2: 1, 3: 1}
    assert sorted((r.id, r.candidate) for r in retrieval.shortlist(some, some, 5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


@pytest.mark.parametrize("most,count", [(1, 3), (4, 2), (32, 5), (3, 40)])
def test_spans(spark, most, count):
    rng = np.random.default_rng(most)
    lists = [[float(x) for x in rng.integers(0, 3, n)] for n in (1, 2, 5, 30, 30, 64)] + [[], None, [1.0] * 12, [2.0, None, 1.0, float("nan"), 1.0]]
    got = retrieval.top_spans(spark.createDataFrame(list(enumerate(lists)), "id int, values array<double>"), most, count).collect()
    want = []
    for i, v in enumerate(lists):
        v = v or []
        spans = [(a, b) for a in range(len(v)) for b in range(a + 1, min(a + most, len(v)) + 1)]
        scored = [(round(sum(v[a:b]) / (b - a), 12), a, b) for a, b in spans if all(x is not None and x == x for x in v[a:b])]
        for rank, (m, a, b) in enumerate(sorted(scored, key=lambda x: (-x[0], x[2] - x[1], x[1]))[:count], 1):
            want.append((i, rank, a, b, m))
    assert sorted(tuple(r) for r in got) == want


def test_scratch_is_discarded(spark):
    scratch.discard(spark)
    df = scratch.stored(spark.range(3), "three")
    assert df.count() == 3 and scratch.discard(spark) == 1 and scratch.discard(spark) == 0
