"""Searches for all rows as queries, and grounding over a corpus against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from seriesloom.operators import retrieval, vectors

SF = "/root/testdata/sf0.001"


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def embeddings():
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"])
    ids = t["vec_id"].to_numpy()
    return ids, np.stack(t["embedding"].to_pylist()).astype(np.float32).astype(float)


def firsts(score, count):
    """Places of the greatest, ties by place."""
    return np.lexsort((np.arange(len(score)), -np.round(score, 11)))[:count]


def table(spark, names, ids, m):
    return spark.createDataFrame([(*i, [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], f"{names}, vec array<double>")


def test_corpus_grounding_asks_for_every_row(spark):
    ids, m = embeddings()
    got = {}
    for r in entry.queries()["r11_corpus_grounding"](spark, SF).collect():
        got.setdefault(r.id, []).append((r["rank"], r.series, r.score))
    assert set(got) == set(ids.tolist())
    number = np.unique(ids // 10)
    near, patch = unit(m) @ unit(np.stack([m[ids // 10 == s].mean(axis=0) for s in number])).T, unit(m) @ unit(m).T
    best = np.stack([patch[:, ids // 10 == s].max(axis=1) for s in number], axis=1)
    for k, i in enumerate(ids.tolist()):
        listed = np.sort(firsts(near[k], 50))
        want = listed[firsts(best[k][listed], 5)]
        assert [s for _, s, _ in sorted(got[i])] == number[want].tolist()
        assert [x for _, _, x in sorted(got[i])] == pytest.approx(best[k][want].tolist(), abs=2e-9)


def test_best_patch_shortlist_asks_for_every_row(spark):
    ids, m = embeddings()
    got = {}
    for r in entry.queries()["r12_best_patch_shortlist"](spark, SF).collect():
        got.setdefault(r.id, []).append((r["rank"], r.series, r.sim))
    assert set(got) == set(ids.tolist())
    number = np.unique(ids // 10)
    best = np.stack([(unit(m) @ unit(m[ids // 10 == s]).T).max(axis=1) for s in number], axis=1)
    for k, i in enumerate(ids.tolist()):
        want = firsts(best[k], 5)
        assert [s for _, s, _ in sorted(got[i])] == number[want].tolist()
        assert [x for _, _, x in sorted(got[i])] == pytest.approx(best[k][want].tolist(), abs=2e-9)


@pytest.mark.parametrize("queries,path", [(90, "_spans_by_band"), (2, "_spans_by_pair")])
@pytest.mark.parametrize("single", [True, False])
def test_grounding_by_band_and_by_pair(spark, monkeypatch, queries, path, single):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "BAND", 1)
    taken = []
    own = getattr(retrieval, path)
    monkeypatch.setattr(retrieval, path, lambda *a: (taken.append(path), own(*a))[1])
    rng = np.random.default_rng(queries)
    cells = rng.normal(size=(5, 6))
    draw = lambda n: cells[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, 6))
    size = rng.integers(1, 9, 40)
    of = np.repeat(np.arange(40) * 3, size)
    q, p = draw(queries), draw(len(of))
    if single:
        q, p = q.astype(np.float32).astype(float), p.astype(np.float32).astype(float)
    s = np.stack([p[of == i].mean(axis=0) for i in np.unique(of)])
    qi = rng.permutation(1000)[:queries]
    patch = np.concatenate([np.arange(n) for n in size])
    args = table(spark, "id long, group_key long", [(int(i), 0) for i in qi], q), table(spark, "id long, group_key long", [(int(i), 0) for i in np.unique(of)], s)
    got = {}
    for r in retrieval.corpus_grounding(*args, table(spark, "series long, patch int", list(zip(of.tolist(), patch.tolist(), strict=True)), p), near=9, count=4).collect():
        got.setdefault(r.id, []).append((r["rank"], r.series, r.start, r.end, r.score))
    assert taken == [path] and len(got) == queries
    near, all_ = unit(q) @ unit(s).T, unit(q) @ unit(p).T
    for k, i in enumerate(qi.tolist()):
        listed = np.unique(of)[np.sort(firsts(near[k], 9))]
        best = np.array([all_[k][of == x].max() for x in listed])
        want = [(n, int(listed[j]), int(all_[k][of == listed[j]].argmax())) for n, j in enumerate(firsts(best, 4), 1)]
        assert [(n, x, a) for n, x, a, _, _ in sorted(got[i])] == want and all(e == a + 1 for _, _, a, e, _ in got[i])
        assert [x for *_, x in sorted(got[i])] == pytest.approx(np.sort(best)[::-1][:4].tolist(), abs=1e-9)


@pytest.mark.parametrize("m", [np.array([[0.5, -0.0], [3.0, 1e-40]]), np.array([[0.1, 2.0]]), np.array([[1e300, 1.0]]), np.array([[np.nan, 1.0]])])
def test_numbers_travel_unchanged(m):
    single, data = vectors.to_bytes(m)
    assert vectors.from_bytes(len(m), single, data).tobytes() == m.tobytes()
    assert not single or len(data) == 4 * m.size


def test_a_short_list_has_all_of_two_rounds(spark, monkeypatch):
    """Few results a query, so that both a floor and a block's own count decide, over more blocks than are searched at once."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(50, 4)), rng.normal(size=(400, 4))
    args = [table(spark, "id long, group_key long", [(i, 0) for i in range(len(m))], m) for m in (q, c)]
    got = {(r.id, r["rank"]): r.candidate for r in retrieval.shortlist(*args, 3).collect()}
    sim = unit(q) @ unit(c).T
    assert got == {(k, n): int(j) for k in range(50) for n, j in enumerate(firsts(sim[k], 3), 1)}


@pytest.mark.parametrize("by_group", [False, True])
def test_copies_are_ties_in_any_block(spark, monkeypatch, by_group):
    """Equal vectors in blocks of several sizes: of equally similar ones, those of the least numbers are listed."""
    monkeypatch.setattr(vectors, "BLOCK", 135)
    rng = np.random.default_rng(7)
    kinds = rng.normal(size=(6, 64))
    kind = rng.integers(0, 6, 301)
    q = rng.normal(size=(4000, 64))
    series = np.arange(301) // 3 * 2
    rows = [(i, int(series[i % 301])) for i in range(4000)]
    args = [table(spark, "id long, group_key long", rows[: len(m)], m) for m in (q, kinds[kind])]
    find = retrieval.best_patch_shortlist if by_group else retrieval.shortlist
    got = {(r.id, r["rank"]): r[1] for r in find(*args, 60).collect()}
    sim = np.round(unit(q) @ unit(kinds).T, 10)[:, kind]
    for k in range(4000):
        if by_group:
            number = np.unique(series)
            want = number[firsts(np.array([sim[k][series == s].max() for s in number]), 60)]
        else:
            want = firsts(sim[k], 60)
        assert [got[k, n] for n in range(1, 61)] == want.tolist()
