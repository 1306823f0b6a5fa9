"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, then exact verification.

1. Each document becomes the set of its five-word shingles (64-bit hashes), the set's size and digest, and 128
   registers. A register keeps, of the least hash under its own multiplier, the number of leading zeros (6 bits)
   and the 10 bits after the first one. Equal sets form one class, which gets a number; a row is told by its locator,
   so rows that repeat a key are apart.
2. Four registers make a band of 64 bits; classes that agree on one of 32 bands are candidates (a pair at 0.75
   escapes all bands with probability 5e-6). In each bucket, every class is first paired with the bucket's
   smallest class only.
3. Pairs whose estimate, corrected for chance collisions of compressed registers, is more than five standard
   errors below the threshold are dropped; the others are compared on their full sets.
4. Components of the confirmed links. Buckets that still span several components are searched in blocks for
   pairs across components, so that no link is lost because a bucket's smallest class was not similar. Only then
   do components take the smallest key of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, located, meet, stored
from .graph import components

SHINGLE, BANDS, ROWS = 5, 32, 4
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Classes of a bucket that are compared in one block.
BLOCK = 512
MEMO_WORDS = 150_000
_random = np.random.default_rng(20240607)
_MULTIPLIERS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence if it has fewer words."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    mixed = h[:n] * _PLACES[0]
    for i in range(1, SHINGLE):
        mixed = (mixed ^ (mixed >> np.uint64(29))) + h[i : i + n] * _PLACES[i]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    out = np.unique(mixed ^ (mixed >> np.uint64(32)))
    if len(_words) > MEMO_WORDS:
        _words.clear()
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 HyperMinHash registers of a set: leading zeros times 1024 plus the mantissa."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * _MULTIPLIERS).min(axis=0), out=least)
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    mantissa = (np.maximum(fraction - 0.5, 0) * (2 << MANTISSA_BITS)).astype(np.uint16)
    return ((53 - exponent).astype(np.uint16) << MANTISSA_BITS) | mantissa


@lru_cache(maxsize=4096)
def chance_collision(log_n: int, log_m: int) -> float:
    """Probability that registers of two unrelated sets of 2**(log/2) elements agree."""
    n, m = 2 ** (log_n / 2), 2 ** (log_m / 2)
    level = np.arange(54)[:, None]
    x = 2.0 ** -(level + 1) * (1 + (np.arange(16) + 0.5) / 16)
    density = n * np.exp((n - 1) * np.log1p(-x)) * m * np.exp((m - 1) * np.log1p(-x))
    cell = 2.0 ** -(level + 1 + MANTISSA_BITS)
    return float((density * cell**2 * 2**MANTISSA_BITS / 16).sum())


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the numbers of equal registers, less the expected chance collisions."""
    logs = np.stack([np.round(2 * np.log2(np.maximum(v, 1))).astype(int) for v in (n, m)], axis=-1)
    kinds, place = np.unique(logs.reshape(-1, 2), axis=0, return_inverse=True)
    p = np.array([chance_collision(int(a), int(b)) for a, b in kinds])[place.reshape(-1)].reshape(np.shape(n))
    return (equal / REGISTERS - p) / (1 - p)


def least_estimate(threshold: float) -> float:
    """Pairs below this estimate are at or above the threshold with probability under one in a million."""
    return threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text or "")
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(registers(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, batch.column(2)], ["id", "n", "digest", "bands", "place"])
    _words.clear()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t or "").tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "elements"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of bands as rows of 32 numbers."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, BANDS)


def _promising(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch.column(i), np.float64) for i in (2, 3))
            left, right = (_matrix(batch.column(i)).view(np.uint16) for i in (4, 5))
            keep = estimate((left == right).sum(axis=1), n, m) >= least_estimate(threshold)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of hashes reach the similarity."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.sort(np.concatenate((x, y)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Confirmed links between components of a bucket's block pair; a pair is looked at in its first bucket only.

    Components that a link of this block has joined need no further link here, so a block gives fewer rows than
    it has classes.
    """
    threshold = percent / 100

    def links(group: pa.Table) -> pa.RecordBatch:
        ids, comp, n, side, lead, bucket_band = (np.asarray(group.column(i)) for i in (3, 4, 5, 6, 7, 8))
        bands = _matrix(group.column(9).combine_chunks())
        sets = group.column(10)
        regs = bands.view(np.uint16)
        rows, cols = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        ratio = np.minimum.outer(n[rows], n[cols]) >= threshold * np.maximum.outer(n[rows], n[cols])
        mask = (comp[rows][:, None] != comp[cols]) & ratio & ((ids[rows] != lead[0])[:, None] & (ids[cols] != lead[0]))
        if side[0] == 2:
            mask &= ids[rows][:, None] < ids[cols]
        i, j = np.nonzero(mask)
        found, guesses = [], []
        for at in range(0, len(i), 20_000):
            a, b = rows[i[at : at + 20_000]], cols[j[at : at + 20_000]]
            guess = estimate((regs[a] == regs[b]).sum(axis=1), n[a].astype(float), n[b].astype(float))
            keep = ((bands[a] == bands[b]).argmax(axis=1) == bucket_band[0]) & (guess >= least_estimate(threshold))
            found.append(np.stack([a, b])[:, keep])
            guesses.append(guess[keep])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out: list[tuple[int, int]] = []
        for k in np.argsort(-np.concatenate(guesses), kind="stable").tolist() if guesses else []:
            x, y = int(a[k]), int(b[k])
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q and _similar(sets[x].as_buffer(), sets[y].as_buffer(), percent):
                root[max(p, q)] = min(p, q)
                out.append((int(ids[x]), int(ids[y])))
        return pa.RecordBatch.from_arrays([pa.array([max(o) for o in out], pa.int64()), pa.array([min(o) for o in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[:, a].tolist())
                if held and key != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _near(docs: DataFrame, percent: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """`docs` with locators, and per row: own (its key), n, place (its locator), component (smallest key reachable),
    kept_at (the locator of the component's row that stays); no component for a null key or an empty set."""
    threshold = percent / 100
    places = located(docs)
    rows = places.select(places[f"`{key}`"].cast("long").alias("own"), places[f"`{text}`"].cast("string").alias("t"), F.col(PLACE).alias("place"))
    kinds = stored(rows.mapInArrow(_signatures, "own long, n long, digest binary, bands array<long>, place string"), "signatures")
    full = kinds.where("n > 0 and own is not null")
    least = full.groupBy("digest", "n").agg(F.min(F.struct("own", "place"))["place"].alias("place"), F.count("*").alias("copies"))
    classes = stored(full.join(least.select("place", "copies"), "place").withColumn("id", F.monotonically_increasing_id()), "classes")

    keys = classes.select(F.col("id"), F.posexplode("bands").alias("band", "value")).select("id", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(meet(keys, shared, ["bucket"], "size", "id"), "buckets")

    wanted = classes.select("id", "place").join(buckets.select("id").distinct(), "id", "left_semi")
    bodies = rows.select("place", "t").join(wanted, "place").select("id", "t")
    sets = stored(bodies.mapInArrow(_sets, "id long, elements binary"), "sets")
    sized = classes.select("id", "n", "bands")

    def other(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in df.columns])

    stars = buckets.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    leads = stars.groupBy("b").agg(F.count("*").alias("partners"))
    both = meet(stars.join(other(sized, "a"), "a"), leads.join(other(sized, "b"), "b"), ["b"], "partners", "a").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    likely = stored(both.select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(_promising(threshold), "a long, b long"), "likely")
    leads = likely.groupBy("b").agg(F.count("*").alias("partners"))
    full_sets = meet(likely.join(other(sets, "a"), "a"), leads.join(other(sets, "b"), "b"), ["b"], "partners", "a").select("a", "b", "elements_a", "elements_b")
    first = stored(components(full_sets.mapInArrow(_confirmed(percent), "a long, b long")), "components")

    labelled = buckets.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    spanning = labelled.where("size > 2").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    open_rows = meet(labelled, shared.select("bucket", F.col("size").alias("rows")).join(spanning, "bucket"), ["bucket"], "rows", "id").drop("rows").join(sized, "id").join(sets, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = open_rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("partner") == F.col("block"), 2).when(F.col("block") < F.col("partner"), 0).otherwise(1)
    dealt = dealt.select("bucket", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "id", "component", "n", side.alias("side"), "lead", "band", "bands", "elements")
    blocks = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = blocks.mapInArrow(_across(percent), "a long, b long")

    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    found = components(links)
    by_class = classes.select("digest", "n", "copies", "own", "place", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = by_class.groupBy("component").agg(F.min(F.struct("own", "place")).alias("head"), F.count("*").alias("members"))
    named = meet(by_class.drop("own", "place"), heads, ["component"], "members", "id").select("digest", "n", "copies", F.col("head.own").alias("component"), F.col("head.place").alias("kept_at"))
    linked = meet(full.select("own", "n", "digest", "place"), named, ["digest", "n"], "copies", "place").select("own", "n", "place", "component", "kept_at")
    alone = kinds.where("n = 0 or own is null").select("own", "n", "place", F.lit(None).cast("long").alias("component"), F.lit(None).cast("string").alias("kept_at"))
    return places, linked.unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key, n_shingles, component_id (smallest key reachable by links), kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets. A null or empty text
    has no shingles and no links. Rows with a null key are not linked (component_id null, kept true). Rows that
    repeat a key have each the component of their own text; all rows whose key is the component's are marked kept
    (drop_near_duplicates() leaves one). Copies are never expanded into pairs; an empty table gives no rows; other
    columns are not read.
    """
    _, found = _near(docs, percent, text, key)
    component = F.coalesce("component", "own")
    return found.select(F.col("own").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("own"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component exactly one, that of the smallest key (of
    rows that share it, the one that lies first in the files); rows without a key or without words all stay."""
    places, found = _near(docs, percent, text, key)
    gone = found.where(F.col("place") != F.col("kept_at")).select(F.col("place").alias(PLACE))
    return places.join(gone, PLACE, "left_anti").select(*[places[f"`{c}`"] for c in docs.columns])
