"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import functools
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seriesloom.llm import common, exact_dedup, html, id_files, language, matroska, mixing, neardup, packing, queries, token_counts, tokens, toxicity
from seriesloom.llm.graph import components

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "x<|endoftext|>y <|startoftext|> z", "  lead", "trail  ", "I'm 's it's", "café ́x", "▁ a▁ b", "a\tb c", "12 345 6789", "| a | b|c", "你好 world", "AİΣ x", "\x00 a", "a \x1c b", "a   b", "Ünï-cödé*** it's", "The THE the. the, Straße", "a\nb", "a.\nLas so", "\nx", "x\n", "a\n\nb", "a.\n\nB c", "a\n\tb", "é\nÉ", "x'\ns", "it'\nll 'll", "a\x0bb\x0cc \x85 \xa0 d"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, digest string, slot int, k string, t int, size int, taken int"


def docs(spark, rows):
    """(doc_id, text, source) rows as documents with extra columns that carry the operators' own names."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), -1, "x", "y", 3, "k", 4, 5, 6) for i, t, s in rows], SCHEMA)


def edge_rows():
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None, "a"), (2, "", None), (3, "one two", "a"), (4, "one two", "a"), (4, "one two", "a"), (5, long_text, "b"), (6, long_text + " end", "b"), (None, "one two", "a"), (7, "ÀB c", "c"), (8, "Àb C", "c"), (9, "   \n ", "c")]


@functools.cache
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path) if path.endswith(".model") else Tokenizer.from_file(path)


def whole_ids(path, text):
    if path.endswith(".model"):
        return library(path).encode(text)
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_pieces_give_the_library_ids(path):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(letters) for _ in range(60)) for letters in ("ab é.,!'\n0*Ñß|<", "abC  \n\n.,'", "xÀÿ×ŁőΣςİıſ \n") for _ in range(100)]
    ids, ends = tokens.encoder(path).encode(pa.array(texts))
    counts = tokens.encoder(path).count(pa.array(texts))
    for i, t in enumerate(texts):
        want = whole_ids(path, t)
        assert ids[ends[i] : ends[i + 1]].tolist() == want, repr(t)
        assert counts[i] == len(want)


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_long_texts_are_cut_safely(path, monkeypatch):
    text = " ".join(f"word{i % 31}, und so\nweiter." for i in range(400))
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 500)
    assert token_counts.lengths(pa.array([text, "a b", ""]), path).tolist() == [len(whole_ids(path, t)) for t in (text, "a b", "")]


def test_token_counts_edges(spark):
    got = token_counts.token_counts(docs(spark, edge_rows()), PIECE, limit=10).collect()
    want = Counter((i, len((t or "").encode()), len(whole_ids(PIECE, t or ""))) for i, t, _ in edge_rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, window = int(rng.integers(1, 120)), int(rng.integers(8, 40))
        places, cost = packing.cut_places(np.array([n]), np.unique(rng.integers(1, n + 1, 6)), n)
        places, cost = places[np.concatenate((np.diff(places, prepend=0) > 0,))], cost[np.diff(places, prepend=0) > 0]
        if np.diff(places, prepend=0).max() > window:
            continue
        best = {0: 0}
        for j, c in zip(places.tolist(), cost.tolist(), strict=True):
            best[j] = min(f + window - (j - i) + c for i, f in best.items() if j - i <= window)
        cuts = packing.best_cuts(places, cost, window).tolist()
        of = dict(zip(places.tolist(), cost.tolist(), strict=True))
        total = sum(window - (b - a) + of[b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
        assert total == best[n] and cuts[-1] == n


def check_pieces(pieces, rows):
    by_doc = defaultdict(list)
    windows = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert sum(r.length for r in own) <= 1024
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
    for i, t in rows:
        ids = np.array([*whole_ids(BYTE, t or ""), 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    return len(windows)


def test_packing_covers_every_id(spark, monkeypatch):
    rows = [(i, t, s) for i, t, s in edge_rows() if i not in (4, None)]
    pieces = packing.pack(docs(spark, rows).coalesce(1), BYTE).collect()
    count = check_pieces(pieces, [(i, t) for i, t, _ in rows])
    assert count <= -(-sum(p.length for p in pieces) // 1024) * 1.05 + 1
    assert packing.pack(docs(spark, []), BYTE).count() == 0
    # rows that repeat a key, or have none, are documents of their own: in one partition the pieces follow their order
    pieces = sorted(packing.pack(docs(spark, edge_rows()).coalesce(1), BYTE).collect(), key=lambda r: (r.sequence_id, r.offset))
    out = [(r.doc_id, r.doc_tokens) for r in pieces if r.start == 0]
    assert out == [(i, len(whole_ids(BYTE, t or "")) + 1) for i, t, _ in edge_rows()]
    assert sum(r.length for r in pieces) == sum(n for _, n in out)


def test_settled_cuts_are_those_of_the_whole_stream():
    rng = np.random.default_rng(5)
    for _ in range(60):
        window = int(rng.integers(16, 90))
        planner, all_places, all_cost, got, base = packing.Planner(window), [], [], [], 0
        for n in rng.integers(1, 200, 12).tolist():
            places, cost = packing.cut_places(np.array([n]), np.unique(rng.integers(1, n + 1, 3)), n, base)
            planner.extend(places + base, cost)
            got += planner.settle(last=False)
            all_places.append(places + base)
            all_cost.append(cost)
            base += n
        got += planner.settle(last=True)
        assert got == packing.best_cuts(np.concatenate(all_places), np.concatenate(all_cost), window).tolist()
        assert max(np.diff([0, *got])) <= window


def test_encoder_forgets_and_still_knows(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    enc = tokens.WordBpe(WORD)
    for k in range(0, 400, 10):
        texts = [f"w{i} Word{i}, un\nmot" for i in range(k, k + 30)]
        ids, ends = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole_ids(WORD, t) for t in texts]
    assert len(enc.keys) < 250


def test_packing_of_a_table_is_tight(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = queries.op2_packing(spark, SF).collect()
    count = check_pieces(pieces, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert count * 1024 <= 1.03 * sum(p.length for p in pieces) + 1024


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000])
def test_permutation(spark, n):
    image = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
    assert sorted(r.p for r in image.collect()) == list(range(n))


def levels(sizes, share=1.5, most=2.0):
    """Targets by sharing out and resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", "c", "d", None, "e"])) for i in range(400)] + [(900, None, "z")]
    got = mixing.mixed_words(docs(spark, rows), seed=3).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = levels(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 20
    again = mixing.mixed_words(docs(spark, rows).repartition(7), seed=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixed_words(docs(spark, [])).count() == 0


def test_mixing_keeps_every_row(spark):
    long_text = "w " * 40_000
    rows = edge_rows() + [(None, None, "a"), (None, None, "a"), (1, None, "a"), (20, "w w w w", "a"), (20, "x y", "a"), (20, "x y", "b"), (21, long_text, "b"), (21, long_text, "b"), (None, "z " * 70, None)]
    got = mixing.mixed_words(docs(spark, rows)).collect()
    size = lambda t: len((t or "").encode().split())
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    want = levels(dict(per))
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size(t), per[s]) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    for s, n in per.items():
        assert abs(taken[n] - want[s]) <= 0.01 * want[s] + 3
    again = mixing.mixed_words(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_shard_counts_are_a_draw(spark):
    plan = spark.createDataFrame([("a", 1, 50_000, 10), ("b", 2, 1_000, 10), ("c", 3, 0, 10)], "source string, src long, slots long, shards long")
    plan = plan.withColumn("blocks", F.greatest(F.floor(F.col("slots") / 2), F.lit(1)))
    counts = {(r.src, r.shard): r for r in mixing.shard_counts(plan).collect()}
    assert len(counts) == 20
    for src, total in ((1, 50_000), (2, 1_000)):
        own = [counts[src, k] for k in range(10)]
        assert [r.first for r in own] == np.cumsum([0, *[r["count"] for r in own[:-1]]]).tolist() and sum(r["count"] for r in own) == total
        spread = sum((r["count"] - total / 10) ** 2 / (total / 10) for r in own)  # chi-squared, 9 degrees of freedom
        assert 1 < spread < 30
    slots = mixing.shard_slots(mixing.shard_counts(plan), plan).collect()
    for src, total in ((1, 50_000), (2, 1_000)):
        own = [r for r in slots if r.src == src]
        assert sorted(r.slot for r in own) == list(range(total))
        assert Counter(r.block for r in own) == dict.fromkeys(range(total // 2), 2) and {r.epoch for r in own} == {0, 1}
        assert Counter(r.shard for r in own) == {k: counts[src, k]["count"] for k in range(10)}


def test_mixed_texts_hold_what_is_taken(spark):
    rows = [(i, f"  d{i}  w1\nw2 w3 {'x ' * (i % 40)}", "ab"[i % 2]) for i in range(120)] + [(None, "n o key", "a"), (7, "key of two", "a"), (7, "key of two", "a"), (8, None, "b")]
    table = docs(spark, rows)
    taken = Counter()
    for r in mixing.mixed_words(table).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_texts(table)
    assert out.columns == table.columns
    words, stretches = Counter(), out.collect()
    for r in stretches:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and any(r.text in (t or "") for i, t, _ in rows if i == r.doc_id)
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mixed_texts(docs(spark, [])).count() == 0


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("large", [common.LARGE, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(common, "LARGE", large)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (6, "same five words right here"), (7, "same FIVE words right here")]
    base = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(8, 130):  # a large group of copies with none to many changes
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            text[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    for i in range(130, 170):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 50))) + " " + " ".join(base[:8])))
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == want


def test_near_duplicate_edges(spark):
    got = neardup.near_duplicates(docs(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 3 and by[8].component_id == 7
    assert by[6].component_id == 5 and not by[6].kept and by[1].component_id == 1 and by[None].kept
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_near_duplicates_by_text_not_by_key(spark, parts):
    """Rows that share a key but not the text keep their own links, however the rows lie."""
    base = [f"w{i}" for i in range(40)]
    texts = {"a": base, "b": base[:39] + ["x"], "c": [f"v{i}" for i in range(40)], "d": [f"v{i}" for i in range(39)] + ["y"], "e": [f"u{i}" for i in range(30)]}
    rows = [(1, "a"), (2, "b"), (2, "d"), (3, "c"), (3, "e"), (3, "e"), (4, "a"), (5, "e"), (None, "a")]
    table = docs(spark, [(i, " ".join(texts[t]), t) for i, t in rows]).repartition(parts)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 3, True), (3, 3, True), (4, 1, False), (5, 3, False), (None, None, True)])
    left = neardup.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert Counter((r.doc_id, r.source) for r in left.collect()) == Counter([(1, "a"), (2, "d"), (3, "e"), (None, "a")])


def test_estimates_are_close():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
        x, y = np.concatenate((common, a)), np.concatenate((common, b))
        equal = np.array([(neardup.registers(x) == neardup.registers(y)).sum()])
        errors.append(float(neardup.estimate(equal, np.array([350.0]), np.array([350.0]))[0]) - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 140), 100)}


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    return sorted(((i, max(x for x in own if x is not None) if any(x is not None for x in own) else None, len(own), hashlib.sha256(t).hexdigest()) for t, own in groups.items() for i in own), key=repr)


def test_exact_duplicates(spark):
    rows = [(i, t) for i, t, _ in edge_rows()]
    got = exact_dedup.exact_duplicates(docs(spark, edge_rows())).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=repr) == brute_exact(rows)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_exact_duplicates_survive_digest_clashes(spark):
    weak = lambda t: str(zlib.crc32(t) % 3)
    rows = [(i, f"text {i % 6}") for i in range(40)]
    got = exact_dedup.exact_duplicates(docs(spark, [(i, t, None) for i, t in rows]), weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(x[:3] for x in brute_exact(rows))


def test_state_carries_over(spark, tmp_path):
    feed, state = f"file://{tmp_path}/feed", f"file://{tmp_path}/state"
    for rows in ([(1, "a", None), (2, "b", None)], [(3, "A", None)]):
        exact_dedup.arrive(docs(spark, rows), feed)
        exact_dedup.consume(spark, feed, state)
    assert sorted((r.keep_id, r.group_size) for r in exact_dedup.known_groups(spark, state).collect()) == [(2, 1), (3, 2)]


def test_drop_duplicates_leaves_one_row_a_text(spark, tmp_path):
    rows = edge_rows() + [(None, "ONE two", "a"), (None, "no key", "a"), (None, "NO key", "b"), (3, "three", "a"), (3, "other", "a"), (3, "Other", "a")]
    table = docs(spark, rows)
    table.repartition(3).write.parquet(f"file://{tmp_path}/docs")
    for source in (table, spark.read.parquet(f"file://{tmp_path}/docs")):
        for digest in (exact_dedup.sha256_hex, lambda t: str(len(t) % 2)):
            out = exact_dedup.drop_duplicates(source, digest)
            assert out.columns == table.columns
            got = [(r.doc_id, (r.text or "").encode().lower()) for r in out.collect()]
            best = {}
            for i, t, _ in rows:
                k = (t or "").encode().lower()
                best[k] = max(best.get(k, -1), -1 if i is None else i)
            assert sorted((-1 if i is None else i, t) for i, t in got) == sorted((i, t) for t, i in best.items())
    assert exact_dedup.drop_duplicates(docs(spark, [])).count() == 0


def test_large_groups_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "LARGE", 5)
    rows = [(i, "Hot text" if i % 3 else f"t{i // 6}", None) for i in range(120)]
    got = exact_dedup.exact_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=repr) == brute_exact([(i, t) for i, t, _ in rows])


def test_intermediate_folders_can_be_discarded(spark):
    common.discard(spark)
    assert exact_dedup.exact_duplicates(docs(spark, edge_rows())).count() == len(edge_rows())
    assert common.discard(spark) >= 4 and common.discard(spark) == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 3, 3, 9, 1000, 10**6], list(range(0, 5000, 7))])
def test_elias_fano(values):
    coded = id_files.EliasFano.encode(np.array(values))
    assert coded.select(0, len(values)).tolist() == values
    assert [int(coded.select(i, i + 1)[0]) for i in range(len(values))] == values
    for a, b in ((255, 513), (256, 512), (250, 260), (300, 300), (0, 257)):
        assert coded.select(min(a, len(values)), min(b, len(values))).tolist() == values[a:b]
    if len(values) > 100:
        assert len(coded.low) + len(coded.high) + len(coded.directory) < 8 * len(values) / 3


@pytest.mark.parametrize("segment", [id_files.SEGMENT_IDS, 5])
def test_id_files_round_trip(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", segment)
    monkeypatch.setattr(id_files, "READ_DOCS", 2)
    rows = sorted(((i, t) for i, t, _ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    path = f"file://{tmp_path}/ids"
    id_files.write_id_files(docs(spark, edge_rows()), path, WORD, 1)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in id_files.document_table(id_files.read_id_files(spark, path)).collect()), key=lambda r: r[0])
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array([*whole_ids(WORD, t or ""), 1], "<u4")
        assert r == (start, i, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    id_files.write_id_files(docs(spark, []), f"file://{tmp_path}/none", WORD, 1)
    assert id_files.document_table(id_files.read_id_files(spark, f"file://{tmp_path}/none")).count() == 0


def test_matroska_round_trip(spark):
    for n in (0, 1, 191, 192, 193, 1536, 1537, 192 * 128 + 1, 122_000):
        payload = matroska.padded("é" + "x" * n)
        media = matroska.write(payload)
        parsed = matroska.parse(media)
        assert b"".join(media[p.begin : p.end] for p in parsed.packets) == payload
        assert [p.timestamp for p in parsed.packets][:2] in ([0], [0, 0])
        assert all(parsed.segment + c[2] in parsed.clusters for c in parsed.cues)
    got = {r.doc_id: r for r in matroska.digest(matroska.store(docs(spark, edge_rows()))).collect()}
    assert got[1].payload_sha256 == got[2].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest() and got[1].n_bytes == 0
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].tail_crc32 == zlib.crc32(b" " * 16)


def test_matroska_lacing_and_unknown_sizes():
    e = matroska.element
    block = lambda flags, rest: e(matroska.SIMPLE_BLOCK, b"\x81\x00\x01" + bytes([flags]) + rest)
    xiph = block(0x02, b"\x01" + b"\xff\x05" + b"a" * 260 + b"bb")
    ebml = block(0x06, b"\x02" + b"\x83" + b"\xbe" + b"aaa" + b"bb" + b"c")
    unknown = lambda kind: kind.to_bytes(4, "big") + b"\xff"
    data = e(matroska.EBML, b"") + unknown(matroska.SEGMENT) + unknown(matroska.CLUSTER) + e(matroska.TIMESTAMP, b"\x05") + xiph + unknown(matroska.CLUSTER) + e(matroska.TIMESTAMP, b"\x09") + ebml
    parsed = matroska.parse(data)
    assert [(p.timestamp, p.end - p.begin) for p in parsed.packets] == [(6, 260), (6, 2), (10, 3), (10, 2), (10, 1)]


def test_packet_table_of_broken_files(spark):
    good = matroska.write(matroska.padded("a"))
    media = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, good[:-3]), (5, b"\x00junk")], "doc_id long, media binary")
    rows = matroska.packets(media).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 4: 1, 5: 1}
    assert all((r.error is None) == (r.doc_id == 1) for r in rows)


PAGE = """<!doctype html><title>T</title><body><h1>Head &amp; line</h1><p>One <b>two<p>Three<br>four <span style="display:none">no</span> five
<ul><li>a<li>b<ul><li>b1</ul></ul><ol start=3><li>x<li value=9>z</ol><pre>  k
 l</pre><table><tr><th>Name<th align=right>Qty<tr><td>apple<td align=right>3<tr><td colspan=2>wide cell</table>end<script>var a="</p>"</script>"""


def test_html_layout():
    assert html.extract(PAGE).split("\n") == ["Head & line", "", "One two", "", "Three", "four five", "", "- a", "- b", "  - b1", "", "3. x", "9. z", "", "  k", " l", "", "Name   Qty", "apple    3", "wide cell", "", "end"]


@pytest.mark.parametrize(("page", "text"), [(None, None), ("", ""), ("a<b", "a<b"), ("<p hidden>x</p>y", "y"), ("<div>" * 3000 + "deep", "deep"), ("<table><tr>x<td>y</table>", "x\n\ny"), ("<select><option>a<option selected>b</select>", "b"), ("&lt;b&gt; <!-- c --> d", "<b> d"), ("<details><summary>s</summary>h</details>", "s")])
def test_html_cases(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><div>Title</div><tr><td>x</table>", "Title\n\nx"),
        ("<table><tr><b>note</b><td>x</table>", "note\n\nx"),
        ("<table><tbody><center>c</center><p>p<tr><td>x<td>y</table>z", "c\n\np\n\nx  y\n\nz"),
        ("<table><colgroup><a>link</a><tr><td>x</table>", "link\n\nx"),
        ("<table><form><tr><td>x</form></table>", "x"),
        ("<table><tr><td>a<table><tr><div>in</div><td>b</table></table>", "a\nin\nb"),
        ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
        ("<ul><li>o<table><li>i</li><tr><td>x</table></ul>", "- o\n  - i\n\n  x"),
        ("<table><template><tr><td>no</template><tr><td>x</table>", "x"),
        ("<tr>x<td>y", "xy"),
        ("a<svg><title>no</title><defs><text>no</text></defs>no<rect/><g><text>Jan</text><text>F<tspan>eb</tspan></text></g></svg>b", "a Jan Feb b"),
        ("<svg><style/><title/><text display=none>no</text><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"),
        ("<svg><path><p>text", "text"),
        ("<p><math><semantics><mrow><mi>x</mi> <mo>=</mo> <mn>1</mn></mrow><annotation>no</annotation></semantics></math>.", "x=1."),
        ("<div>" * 300 + "<div hidden>no</div><template>no</template><b style='display:none'>no</b>yes", "yes"),
        ("<table><tr><td>" * 100 + "<p>a<p>b" + "</table>" * 100, "a\nb"),
        ("<b>" * 300 + "<i><pre>  k</pre></i>", "  k"),
        ("<section>" * 20000 + "<span>" * 20000 + "deep" + "</span>" * 20000 + " end", "deep end"),
        ("<table><tr><td>" * 3000 + "deep", "deep"),
    ],
)
def test_html_shows_all_text(page, text):
    assert html.extract(page) == text


def test_html_deep_lists_keep_their_text():
    got = html.extract("".join(f"<ul><li>w{i} " for i in range(3000)))
    assert got.split() == [x for i in range(3000) for x in ("-", f"w{i}")] and max(map(len, got.split("\n"))) < 500


N = 200_000  # letters of a hostile page
HOSTILE = {
    "spans": "<table><tr>" + "<td colspan=1000>x" * (N // 18),
    "spans in rows": "<table><tr>" + "<td>y" * 1000 + "<tr><td colspan=999>x<td>z" * (N // 26),
    "wide cell": "<table><tr><td>" + "w" * 50_000 + "<tr><td>a<td>b" * (N // 14),
    "nested": "<table><tr><td>x " * (N // 17),
    "nested beside": "<table><tr><td>x<td>" * (N // 20),
    "nested before": "<table><tr><td>" * (N // 28) + "</table><td>x" * (N // 28),
    "nested in lists": "<ul><li><table><tr><td>x " * (N // 25),
    "spans of rows": "<table><tr>" + "".join(f"<td rowspan={60000 - i}>c" for i in range(999)) + "<tr><td align=right>x" * (N // 21),
    "indents": "<ul><li>" * 250 + "<br>x" * (N // 5),
    "columns": "<table>" + ("<tr>" + "<td>x" * 3000) * 12,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_layout_is_bounded_and_keeps_all_text(name):
    page, began = HOSTILE[name], time.process_time()
    text = html.extract(page)
    assert time.process_time() - began < 15
    assert len(text) <= (html.LAYOUT_SHARE + 1) * len(page) + html.LAYOUT_LEAST
    letters = lambda t: Counter(re.sub(r"[\s-]", "", t))
    assert letters(text) == letters(re.sub("<[^>]*>", "", page))


def test_html_tables_beyond_their_share(monkeypatch):
    page = "<table><caption>c</caption><tr><td>a<td>bb<tr><td>ccc<td><p>d<p>e</table><ul><li><table><tr><td>x<tr><td>y</table></ul>"
    assert html.extract(page) == "c\na    bb\nccc  d\n     e\n\n- x\n  y"
    monkeypatch.setattr(html, "LAYOUT_SHARE", 0)
    monkeypatch.setattr(html, "LAYOUT_LEAST", 0)
    assert html.extract(page) == "c\na  bb\nccc\nd\ne\n\n-\nx\ny"


def test_html_indents_are_a_parameter():
    page = "<blockquote>" * 5 + "x"
    assert html.extract(page) == " " * 10 + "x"
    assert html.extract(page, max_indents=2) == " " * 4 + "x"


def test_html_table(spark):
    schema = "page_id long, html string, text string, k int, h string, n_lines long"
    pages = spark.createDataFrame([(1, "<p>x", "y", 1, "z", 9), (2, None, None, None, None, None), (2, "", "y", 1, "z", 9), (None, "<p>a<p>b", "y", 1, "z", 9)], schema)
    got = sorted((r.page_id or 0, r.text or "", r.n_lines) for r in html.visible_text(pages).collect())
    assert got == [(0, "a\n\nb", 3), (1, "x", 1), (2, "", 0), (2, "", 0)]
    assert html.visible_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("part", ["<a ", "x <", '<a "', "<a =\"'", "<!x ", "<?x ", "</a ", "<a=", "<b>x</b>", "<x y='", "<p>", "<td>", "& "])
def test_html_takes_long_pages(part):
    began = time.process_time()
    html.extract(part * (300_000 // len(part)))
    assert time.process_time() - began < 5  # a quadratic scan takes minutes


@pytest.mark.parametrize(("page", "text"), [("a <b x y", "a <b x y"), ('<p class="a" ">t</p>', "t"), ("<p title='a>b'>t", "t"), ('<a href=x"y>t</a>', "t"), ('<a b="c <i>t</i>', '<a b="c t'), ("x < y <!d> z <! w", "x < y z <! w"), ("<p a=b/>t", "t"), ("<svg><g/></svg>t", "t")])
def test_html_tag_ends(page, text):
    assert html.extract(page) == text


def plain_layout(tree):
    """The lines of a tree of (tag, children) by plain recursion: blocks, paragraphs, spans, line breaks, hidden parts."""
    lines, open_, gap = [], "", 0

    def end():
        nonlocal open_, gap
        if open_.strip():
            lines.extend([""] * (gap if lines else 0) + [open_.strip()])
            gap = 0
        open_ = ""

    def walk(node):
        nonlocal open_, gap
        if isinstance(node, str):
            open_ += node
            return
        tag, children = node
        if tag == "template":
            return
        if tag in ("div", "p"):
            end()
            gap = max(gap, int(tag == "p"))
        for c in children:
            walk(c)
        if tag in ("div", "p"):
            end()
            gap = max(gap, int(tag == "p"))

    walk(tree)
    end()
    return "\n".join(re.sub(" +", " ", x) for x in lines)


def test_html_random_trees():
    rng = random.Random(11)

    def grow(depth, inline):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["ab", " c ", "d", " e"])
        tag = rng.choice(["span", "b", "template"] if inline else ["div", "div", "p", "span", "b", "template"])
        return tag, [grow(depth - 1, inline or tag in ("p", "span", "b")) for _ in range(rng.randint(0, 4))]

    def markup(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"

    for _ in range(400):
        tree = ("div", [grow(5, False) for _ in range(3)])
        assert html.extract(markup(tree)) == plain_layout(tree), markup(tree)


def test_toxicity_learns_stems(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ra", "no", "vi", "del", "pos")]
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        text = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if bad:
            text[rng.randrange(len(text))] = "grumph" + rng.choice(["", "en", "ado", "ly", "ist"])
        rows.append((i, " ".join(text), None))
        if i < 500:
            labels.append((i, int(i % 7 != 0), int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs(spark, rows), known).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(500, 700)) >= 195
    edges = toxicity.toxicity(docs(spark, edge_rows()), known).collect()
    assert Counter(r.doc_id for r in edges) == Counter(i for i, _, _ in edge_rows())
    assert toxicity.toxicity(docs(spark, []), known).count() == 0
    assert toxicity.toxicity(docs(spark, rows), known.limit(0)).where("toxic").count() == 0


def brute_features(text):
    """Features of one text in plain Python."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = {f for w in words for f in [w, *(w[:n] + "*" for n in range(3, 7) if len(w) >= n)]}
    n, size = max(len(words), 1), max(len(text or ""), 1)
    signs = max(size - sum(map(len, words)) - n, 0)
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return out | {f"#repeats{10 * (n - len(set(words))) // n}", f"#capitals{10 * capitals // size}", f"#signs{min(9, 20 * signs // size)}"}, len(set(words))


def test_features_match_plain_python():
    texts = [None, "", "  ", "One two, TWO three-fold x1y ünïcödé Straße!", "a" * 9000, *(t for t in ODD if "\x00" not in t and "İ" not in t)]
    own = toxicity.Features(pa.array(texts))
    names = own.names()
    row, number = own.among(names)
    for i, t in enumerate(texts):
        want, distinct = brute_features(t)
        assert {names[int(k)].as_py() for k in number[row == i]} == want and own.distinct[i] == distinct
    empty = toxicity.Features(pa.array([], pa.string()))
    assert [len(x) for x in empty.among(names)] == [0, 0]


def test_chain_probabilities_match_brute_force(spark):
    chain = toxicity.Chain(["a", "b"], [{"bad*": 2.0, "#repeats0": -1.0}, {"two": 1.5}], [0.3, -0.2], [[], [2.5]], [-0.5, -1.0])
    texts = ["bad badly two", "two two two two", None, "fine"]
    got = {r.doc_id: r for r in toxicity.predict(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), chain).collect()}
    for i, t in enumerate(texts):
        own, distinct = brute_features(t)
        length, p = np.log1p(distinct) / 5, []
        for k in range(2):
            margin = sum(w for f, w in chain.weights[k].items() if f in own) + chain.lengths[k] * length + sum(a * b for a, b in zip(chain.links[k], p)) + chain.intercepts[k]
            p.append(1 / (1 + np.exp(-margin)))
        assert [got[i].p_a, got[i].p_b] == pytest.approx(p)


def test_folds_choose_their_own_features(spark):
    # "tell" goes with the label in fold 0 alone: without that fold it is no feature
    rows = [("tell x" if k == 0 and y else "x other", k, [y]) for k in range(5) for y in (0, 1) for _ in range(10)]
    counts = toxicity.feature_counts(spark.createDataFrame(rows, "text string, fold int, labels array<int>"), 1)
    totals = {f"n{k}": 20 for k in range(5)} | {f"p0_{k}": 10 for k in range(5)}
    assert "tell" in toxicity.vocabulary(counts, totals, 0, None) and "tell" in toxicity.vocabulary(counts, totals, 0, 3)
    assert "tell" not in toxicity.vocabulary(counts, totals, 0, 0)
    got = {r.f: r for r in counts.collect()}
    assert [got["tell"][f"n{k}"] for k in range(5)] == [10, 0, 0, 0, 0] and got["x"]["p0_2"] == 10


def test_language_held_out(spark):
    got = queries.op10_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held) and held
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    model = language.fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [*edge_rows(), (10, "12 34", "a")]
    got = language.predict_languages(docs(spark, rows), model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    own = {t: {(r.lang_pred, r.score) for r in language.predict_languages(docs(spark, [(i, t, s)]), model).collect()} for i, t, s in rows}
    assert all(len(v) == 1 for v in own.values())
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *next(iter(own[t]))) for i, t, _ in rows)
    for t, ((name, score),) in own.items():
        assert (name, score) == ("und", 0.0) if not language.has_letter(t) else (name in ("de", "en", "es", "fr") and 0 < score <= 1)


def test_language_of_nothing(spark):
    assert language.fit_languages(docs(spark, []).withColumn("lang", F.lit(None).cast("string"))) is None
    assert language.language_id(docs(spark, []).withColumn("lang", F.lit("en"))).collect() == []
    unlearned = language.language_id(docs(spark, edge_rows()).withColumn("lang", F.lit(None).cast("string")))
    assert unlearned.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in unlearned.collect()) == Counter((i, "und", 0.0) for i, _, _ in edge_rows())
    one = language.fit_languages(docs(spark, [(1, "only one language", "a")]).withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in language.predict_languages(docs(spark, [(2, "other", "a"), (3, None, "a")]), one).collect()} == {"xx", "und"}


@pytest.mark.parametrize("parts", [1, 5])
def test_learning_rows_are_the_texts_of_least_hash(spark, parts):
    hot = [(7, "the same key and text", "en")] * 4000 + [(i, "one text of many keys", "de") for i in range(2000)]
    rows = [*hot, *[(7, f"text {i} of the same key", "en") for i in range(900)], *[(i, f"texte {i % 300}", "fr") for i in range(900)], (1, None, "en"), (2, "no language", None), (None, "no key", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    got = Counter((r.lang, r.text) for r in language.learning_rows(table, 60).collect())
    hashes = {(r.lang, r.text): r.h for r in table.dropna(subset=["lang", "text"]).select("lang", "text", F.xxhash64("text").alias("h")).collect()}
    want = [k for own in ("en", "de", "fr") for k in sorted((k for k in hashes if k[0] == own), key=hashes.get)[:60]]
    assert got == Counter(want) and len(want) == 121
    model = language.fit_languages(table, 60)
    assert model.families == sorted({language.family(n) for n in ("en", "de", "fr")})


def test_language_votes_match_a_plain_count():
    rng = np.random.default_rng(3)
    names = ["da", "de", "en", "es", "fr", "zh"]
    families = sorted({language.family(n) for n in names})
    members = [[n for n in names if language.family(n) == f] for f in families]
    pairs = [[(i, j, rng.normal(size=language.BUCKETS + 1)) for i in range(len(m)) for j in range(i + 1, len(m))] for m in members]
    model = language.Languages(families, rng.normal(size=(len(families), language.BUCKETS + 1)), members, pairs)
    texts = [" ".join(rng.choice(["ab", "é", "wort", "mañana", "字"], 5)) for _ in range(80)]
    got = model.predict(np.stack([language.vector(t) for t in texts]))
    chance = lambda w, x: 1 / (1 + np.exp(-2 * float(np.clip(w @ np.append(x, 1.0), -15, 15))))
    for text, name, score in zip(texts, *got, strict=True):
        x = language.vector(text)
        shares = [chance(w, x) for w in model.family_weights]
        f = shares.index(max(shares))
        votes = [0.0] * len(members[f])
        for i, j, w in pairs[f]:
            votes[i] += chance(w, x)
            votes[j] += 1 - chance(w, x)
        best = votes.index(max(votes))
        sure = shares[f] / sum(shares) * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1)
        assert name == members[f][best] and abs(score - sure) < 2e-6


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, table, SF)
    assert clean.columns == table.columns and 0 < clean.count() <= table.count()
    exact = corpus_pipeline.drop_exact(spark, table, SF)
    want = {i for i, keep, _, _ in brute_exact([(r.doc_id, r.text) for r in table.collect()]) if i == keep}
    assert {r.doc_id for r in exact.collect()} == want
    near = corpus_pipeline.drop_near(spark, table, SF)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in table.collect()]).items() if c == i}
    assert len(corpus_pipeline.STAGES) == 5
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and all(p.length <= 1024 for p in pieces)


def test_pipeline_stages_take_edges(spark):
    table = docs(spark, edge_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        if name != "packing":
            assert out.columns == table.columns, name
        rows, ids = out.collect(), [i for i, _, _ in edge_rows()]
        if name == "toxicity":
            assert sorted((r.doc_id or 0) for r in rows) == sorted(i or 0 for i in ids)
        elif name == "exact_dedup":  # of each text the largest key, null keys last
            assert sorted(r.doc_id for r in rows) == [2, 4, 5, 6, 8, 9]
        elif name == "near_dedup":  # rows without a key or without words stay
            assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 5, 7, None, 9])
        elif name == "mixing":
            assert {r.doc_id for r in rows} >= {5, 6} and all(r.text.split() for r in rows) and {1, 2, 9}.isdisjoint(r.doc_id for r in rows)
        else:
            assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(ids)
        assert stage(spark, docs(spark, []), SF).count() == 0
