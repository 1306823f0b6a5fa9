"""Best-fit packing, ranked search and hard negatives against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import best_fit, hard_negatives, lexical, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(BYTE)


def docs(spark, rows):
    """(doc_id, text) rows as documents with extra columns that carry the operators' own names."""
    schema = "doc_id long, text string, k long, t string, piece int, length int, part string, place int, ids string, score int, rank int, item string, i int"
    return spark.createDataFrame([(i, t, -1, "x", 7, 8, "p", 9, "q", 10, 11, "r", 12) for i, t in rows], schema)


def whole_ids(text, end_id=2):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")


# --- best fit ---------------------------------------------------------------------------------------------------


def one_by_one(lengths, window):
    """Best-fit decreasing, a document at a time: the documents' lengths of every sequence."""
    rooms, bins = [], []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(rooms)) if rooms[b] >= n]
        if fits:
            b = min(fits, key=lambda b: rooms[b])
        else:
            b = len(rooms)
            rooms.append(window)
            bins.append([])
        rooms[b] -= n
        bins[b].append(n)
    return bins


@pytest.mark.parametrize("window", [1, 2, 7, 16, 100, 1024])
def test_plan_is_that_of_single_documents(window):
    rng = random.Random(window)
    for case in range(40):
        lengths = [rng.randint(1, window if case % 3 else max(1, window // 3)) for _ in range(rng.choice([0, 1, 5, 60, 300]))]
        counts = Counter(lengths)
        plan = best_fit.best_fit_plan(counts, window)
        bins = defaultdict(list)
        for n in counts:
            rows = [r for r in plan.tolist() if r[0] == n]
            assert [r[1] for r in rows] == sorted({r[1] for r in rows}) and (rows[0][1] == 0)
            for rank in range(counts[n]):
                _, first, sequence, each, offset = max((r for r in rows if r[1] <= rank), key=lambda r: r[1])
                turn, inside = divmod(rank - first, each)
                bins[sequence + turn].append((offset + inside * n, n))
        for own in bins.values():
            own.sort()
            assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= window
        assert sorted(sum(n for _, n in own) for own in bins.values()) == sorted(map(sum, one_by_one(lengths, window)))  # sequences with equal room are alike
        assert sorted(bins) == list(range(len(bins)))


def test_capacity_tree_finds_the_tightest():
    rng = random.Random(3)
    tree, rooms = best_fit.CapacityTree(37), []
    for _ in range(2000):
        need = rng.randint(1, 37)
        want = min((r for r in rooms if r >= need), default=None)
        assert tree.tightest(need) == want
        if want is not None and rng.random() < 0.5:
            tree.take(want)
            rooms.remove(want)
        elif rng.random() < 0.6:
            room = rng.randint(0, 37)
            tree.add(room, 0, 1)
            rooms += [room] * (room > 0)


def test_plan_stays_small_for_many_documents():
    rng = np.random.default_rng(1)
    counts = {n: int(c) for n, c in enumerate(rng.integers(1, 10**9, 1024), 1)}
    plan = best_fit.best_fit_plan(counts, 1024)
    assert len(plan) < 20_000
    taken = sum(n * c for n, c in counts.items())
    assert plan[:, 2].max() * 1024 < 1.01 * taken


def check_fit(pieces, rows, window):
    sequences, own = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append(r)
        own[r.doc_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s[:-1]]]).tolist() and sum(r.length for r in s) <= window
    lengths = []
    for i, ids in rows:
        mine = sorted(own[i], key=lambda r: r.piece)
        count = -(-len(ids) // window)
        assert [r.piece for r in mine] == list(range(count)) and all(r.length == window for r in mine[1:])
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist() and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
        lengths += [r.length for r in mine]
    assert len(lengths) == len(pieces)
    assert len(sequences) == len(one_by_one(lengths, window))


def test_best_fit_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_fit(queries.op13_best_fit(spark, SF).collect(), [(r.doc_id, whole_ids(r.text)) for r in table], 1024)


@pytest.mark.parametrize("parts", [1, 3])
def test_best_fit_edges(spark, parts):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, " ".join(f"w{i % 97}" for i in range(30_000))), (5, "x y"), (5, "x y"), (None, "n o key")]
    got = best_fit.best_fit_pack(docs(spark, rows).repartition(parts), BYTE, window=64, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = whole_ids(t)
        head = len(ids) - (-(-len(ids) // 64) - 1) * 64
        for p, begin in enumerate([0, *range(head, len(ids), 64)]):
            piece = ids[begin : head if p == 0 else begin + 64]
            want[i, p, begin, tuple(piece.tolist())] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    assert all(a == b for s in rooms.values() for a, b in zip([o for o, _ in sorted(s)], np.cumsum([0, *[n for _, n in sorted(s)[:-1]]]).tolist(), strict=True))
    assert len(rooms) == len(one_by_one([r.length for r in got], 64))
    assert best_fit.best_fit_pack(docs(spark, []), BYTE).count() == 0


# --- ranked search ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(rows, items, k):
    bags = [Counter(terms_of(t)) for _, t in rows]
    n = [sum(b.values()) for b in bags]
    number, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = Counter()
    for i, own in asked.items():
        scored = []
        for (key, _), bag, size in zip(rows, bags, n, strict=True):
            m = 50 + (50 * size * number) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if bag[t])
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        for rank, (s, _, _, key) in enumerate(sorted(scored)[:k], 1):
            out[i, rank, key, -s] += 1
    return out


def test_terms():
    texts = ["", None, "Ab-c9_d", " x y Éa\x00É\n\nB ", "你好 WORLD", "--", "a" * 5]
    assert [[t for t in own if t] for own in lexical.term_lists(pa.array(texts)).to_pylist()] == [terms_of(t) for t in texts]
    assert [[t for t in own if t] for own in lexical.term_lists(pa.array(texts)[2:5]).to_pylist()] == [terms_of(t) for t in texts[2:5]]


@pytest.mark.parametrize("parts,accumulators,item_bytes", [(1, 1 << 15, 1 << 20), (5, 7, 1 << 20), (4, 40, 30)])
def test_search_matches_brute_force(spark, monkeypatch, parts, accumulators, item_bytes):
    monkeypatch.setattr(lexical, "ACCUMULATORS", accumulators)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "SEED_PARTS", 2)
    rng = random.Random(parts)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, "w1 " * 30_000), (None, "w3 w5"), (None, "w3 w5"), (303, "w3 w5"), (303, "w3 w5"), (7, "w3, W5! w5"), (304, "É é w9")]
    items = [(j, " ".join(rng.choice(words) for _ in range(12))) for j in range(9)] + [(20, None), (21, "?!"), (22, "unknownword"), (23, "w3 W5"), (23, "w9 é"), (None, "w1 w2"), (24, "w1")]
    table = docs(spark, rows).repartition(parts)
    asked = spark.createDataFrame([(j, t, -1, "x") for j, t in items], "item_id long, text string, doc_id int, terms string")
    got = lexical.ranked_search(table, asked, k=10).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, items, 10)
    assert lexical.ranked_search(docs(spark, []), asked).count() == 0
    assert lexical.ranked_search(table, asked.where("false")).count() == 0


def test_no_accumulators_after_the_bound():
    """A common term behind a rare one: only the documents of the rare one get accumulators, and whole scores."""
    rows = [(pa.array(range(100)), np.full(100, 10), np.array([0, 1], np.int32), np.array([20, 100], np.int32), np.array([*range(20), *range(100)], np.int32), np.ones(120, np.int32))]
    segment = lexical.Segment(rows, np.array([9000, 10]), 100, 1000)
    found, scores, created = segment.search(np.array([0, 1]), 0, 5)
    assert created == 20 and len(found) == 20 and len(set(scores.tolist())) == 1
    _, _, all_created = segment.search(np.array([0, 1]), 0, 50)
    assert all_created == 100
    assert segment.search(np.array([1]), 10**9, 5)[2] == 0


# --- hard negatives ---------------------------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives=5, percent=80):
    rows = [(i, y, v) for i, y, v in rows if y is not None and v is not None]
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for n, (i, y, v) in enumerate(rows):
        if not anchors(i):
            continue
        scored = sorted((-dot(v, w), j is None, j or 0, z == y, j) for m, (j, z, w) in enumerate(rows) if m != n)
        for s, *_, j in [x for x in scored if x[3]][:positives]:
            fit = [x for x in scored if not x[3] and percent * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            for rank, x in enumerate(fit, 1):
                out[i, j, rank, x[4], -s, -x[0]] += 1
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", -1, 3) for i, y, v in rows], "vec_id long, label int, vector array<long>, id string, score int, block int")


@pytest.mark.parametrize("kind,parts,shard,block,step", [("clustered", 3, 40, 4, 7), ("random", 1, 8192, 256, 1024), ("ties", 4, 16, 3, 5), ("copies", 2, 25, 8, 9)])
def test_negatives_match_brute_force(spark, monkeypatch, kind, parts, shard, block, step):
    for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", block), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    if kind == "clustered":
        m = rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] * 100 + rng.normal(size=(300, 8)) * 10
    elif kind == "copies":
        m = np.repeat(rng.normal(size=(3, 8)) * 100, 60, axis=0)
    else:
        m = rng.normal(size=(200, 8)) * (100 if kind == "random" else 0.8)
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in np.floor(v)]) for i, v in enumerate(m)]
    rows += [(900, None, [1] * 8), (901, 1, None), (910, 1, [0] * 8), (920, 2, [5, 5]), (920, 2, [5, 5]), (None, 1, rows[0][2]), (None, 2, rows[0][2]), (930, 9, [3] * 8), (940, 0, [])]
    anchors = lambda i: i is not None and i % 10 == 0
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(parts), F.col("vec_id") % 10 == 0, clusters=5)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, anchors)


def test_negatives_of_none(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1, 2]), (2, 2, [1, 2])]), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(10, 1, [1, 2]), (11, 2, [1, 2])]), F.col("vec_id") % 10 == 0).count() == 0


def test_walks_end_by_the_bound():
    """Rows in two opposite heaps: members walk the near heap's part of the list only, and lose nothing."""
    rng = np.random.default_rng(2)
    near, far = (sign * 1000 + rng.integers(-30, 30, (4000, 16)) for sign in (1, -1))
    m, labels = np.concatenate((far, near)), np.zeros(8000, np.int64)
    centre = np.full((1, 16), 0.25)
    anchors = near[:5]
    spread = hard_negatives._angles(hard_negatives._unit(anchors)[0], centre).max(axis=0)
    rows = hard_negatives.List(m, np.arange(8000), np.zeros(8000, bool), labels, hard_negatives.bounds(m, centre, spread)[:, 0])
    walk = hard_negatives.Walk(anchors, labels[:5], rows)
    kept = walk.positives(6, np.full(5, -np.inf))
    assert walk.walked.max() <= 5 * 1024
    for a, ((place, scores),) in zip(anchors, kept, strict=True):
        assert scores.tolist() == sorted((m @ a).tolist(), reverse=True)[:6] and (rows.m[place] @ a).tolist() == scores.tolist()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(0)
    m, anchors = rng.integers(-300, 300, (500, 12)), rng.integers(-300, 300, (20, 12))
    centre = hard_negatives._unit(anchors.sum(axis=0)[None, :])[0]
    spread = hard_negatives._angles(hard_negatives._unit(anchors)[0], centre).max(axis=0)
    bound = hard_negatives.bounds(m, centre, spread)[:, 0]
    assert (hard_negatives.products(anchors, m) <= hard_negatives._unit(anchors)[1][:, None] * bound[None, :]).all()
    big = np.array([[2**40 + 1, 3]], np.int64)
    assert hard_negatives.products(big, np.array([[2**20, 1]], np.int64)).tolist() == [[(2**40 + 1) * 2**20 + 3]]
    with pytest.raises(OverflowError):
        hard_negatives.products(big, big)
