"""Retrieval ranks and span grounding from embeddings.

Searches run over metric indexes (operators.vectors): pairs of blocks whose bounds show that they cannot change a result
are not looked at, and a pair that is looked at leaves only what a result needs (a best candidate, a number above it,
a short list), never the similarities themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .vectors import SAME, Side, band, banded, block_pairs, folded, from_bytes, matrix, met, metric_index, nearest_pairs, part_count, to_bytes, unit, unit_rows

#: Positive pairs a query up to which they are compared one by one; beyond, block by block.
FEW_POSITIVES = 64
#: Blocks whose candidates give a short list's first floors; candidate blocks up to which all are searched at once.
HEAD, ONCE = 2, 8


def normalized(vec: Column) -> Column:
    """The vector (array of doubles) at unit length; the norm is at least 1e-8."""
    norm = F.greatest(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-8))
    return F.transform(vec, lambda x: x / norm)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _products(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of rows of a with rows of b one by one: equal vectors give equal ones, which those of a whole block need
    not (they differ in the last digit by place and size), so ties stay ties."""
    parts = [np.zeros(0), *(np.einsum("ij,ij->i", a[row[k : k + 32768]], b[col[k : k + 32768]]) for k in range(0, len(row), 32768))]
    return np.concatenate(parts)


def _best_by_pair(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, sim, at: each query's best candidate of its group, from an equality join on the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(["id", "at", "sim"], b.column(0), b.column(1), np.einsum("ij,ij->i", unit_rows(b.column(2)), unit_rows(b.column(3))))

    queries, candidates = (df.where(F.col("vec").isNotNull()) for df in (queries, candidates))
    pairs = queries.select("id", "group_key", "vec").join(candidates.select(F.col("id").alias("at"), "group_key", F.col("vec").alias("other")), "group_key")
    return pairs.select("id", "at", "vec", "other").mapInArrow(run, "id long, at long, sim double")


def _best_by_block(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """As _best_by_pair(), for large groups: only blocks that share a group meet."""

    def start(q):
        return np.full(len(q.ids), -np.inf), np.full(len(q.ids), np.iinfo(np.int64).max)

    def step(q, c, sim, state):
        sim = np.where(q.groups[:, None] == c.groups[None, :], sim, -np.inf)
        best = np.maximum(state[0], sim.max(axis=1))
        at = np.where(sim >= best[:, None] - SAME, c.ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        return best, np.where(state[0] >= best - SAME, np.minimum(state[1], at), at)

    def finish(_, q, state):
        known = np.isfinite(state[0])
        return _batch(["id", "at", "sim"], q.ids[known], state[1][known], state[0][known])

    def groups(df: DataFrame, name: str) -> DataFrame:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    each = np.unique(np.frombuffer(b.column(1)[i].as_py(), np.int64))
                    yield _batch([name, "grp"], np.full(len(each), b.column(0)[i].as_py(), np.int64), each)

        return df.select("block", "groups").mapInArrow(own, f"{name} long, grp long")

    left, right = metric_index(queries, by_group=True), metric_index(candidates, by_group=True)
    pairs = groups(left, "q").join(groups(right, "c"), "grp").select("q", "c").distinct()
    return met(pairs, left, right).mapInArrow(lambda b: folded(b, start, step, finish), "id long, at long, sim double")


def rank_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of blocks of two indexes, queries with known similarities, with what their bounds say: none (no candidate
    is above any query's known one), all (all are), look."""
    kind = F.when(F.col("most") < F.col("q_low") - SAME, "none").when(F.col("least") > F.col("q_high") + SAME, "all").otherwise("look")
    return block_pairs(queries, candidates).withColumn("kind", kind)


def first_positive_rank(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query (id, group_key, vec): rank of its first candidate of the same group, candidates + 1 if there is none.
    Ids are unique. Similarities within 1e-12 are equal and ordered by candidate id.

    The best positive comes from the pairs of a group; the candidates above it from one pass over the pairs of blocks
    that bounds leave open. That a pass computes a similarity a little differently is nothing above it.
    """

    def step(q, c, sim, count):
        apart = sim - q.sims[:, None]
        count = count + (apart > SAME).sum(axis=1)
        tied = np.abs(apart) <= SAME
        for r in np.flatnonzero(tied.any(axis=1)):
            count[r] += (c.ids[tied[r]] < q.ats[r]).sum()
        return count

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(batches, lambda q: np.zeros(len(q.ids), np.int64), step, lambda _, q, count: _batch(["id", "above"], q.ids, count))

    total = candidates.count()
    sizes = queries.groupBy("group_key").agg(F.count("*").alias("nq")).join(candidates.groupBy("group_key").agg(F.count("*").alias("nc")), "group_key")
    work = sizes.agg(F.sum("nq").alias("q"), F.sum(F.col("nq").cast("double") * F.col("nc")).alias("pairs")).first()
    few = (work.pairs or 0) <= FEW_POSITIVES * (work.q or 0)
    found = stored((_best_by_pair if few else _best_by_block)(queries, candidates), "positives")
    top = found.join(found.groupBy("id").agg(F.max("sim").alias("best")), "id").where(F.col("sim") >= F.col("best") - SAME)
    top = top.groupBy("id").agg(F.max("best").alias("sim"), F.min("at").alias("at"))
    left, right = metric_index(queries.select("id", "group_key", "vec").join(top, "id")), metric_index(candidates)
    pairs = stored(rank_pairs(left, right), "block-pairs")
    seen = met(pairs.where("kind = 'look'"), left, right).mapInArrow(above, "id long, above long").groupBy("id").agg(F.sum("above").alias("above"))
    ids = left.select(F.col("block").alias("q"), "ids").mapInArrow(_members, "q long, id long")
    whole = ids.join(pairs.where("kind = 'all'").groupBy("q").agg(F.sum("c_n").alias("whole")), "q").select("id", "whole")
    ranks = top.select("id").join(seen, "id", "left").join(whole, "id", "left")
    known = ranks.select("id", (F.coalesce("above", F.lit(0)) + F.coalesce("whole", F.lit(0)) + 1).alias("rank"))
    return queries.select("id").join(known, "id", "left").select("id", F.coalesce("rank", F.lit(total + 1)).cast("long").alias("rank"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids = np.frombuffer(b.column(1)[i].as_py(), np.int64)
            yield _batch(["q", "id"], np.full(len(ids), b.column(0)[i].as_py(), np.int64), ids)


def rank_report(ranks: DataFrame) -> DataFrame:
    """R@1, R@5, R@10, median, mean and mean reciprocal rank."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.agg(F.count("*").alias("queries"), at(1).alias("r1"), at(5).alias("r5"), at(10).alias("r10"), F.percentile("rank", F.lit(0.5)).alias("median"), F.avg("rank").alias("mean"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def _shortlist(left: DataFrame, right: DataFrame, count: int, by_group: bool) -> DataFrame:
    """q (the query's block), id, candidate (its id, or its group), sim, rank: the `count` best of each query of an
    index, from two rounds: the blocks nearest to a block of queries give floors, then come the blocks that may hold
    something above them."""
    pairs = stored(block_pairs(left, right), "block-pairs")

    def tops(row: np.ndarray, name: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if by_group:  # a group that lies in several blocks: its greatest
            order = np.lexsort((-sim, name, row))
            row, name, sim = row[order], name[order], sim[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])))[: len(row)]
            row, name, sim = row[new], name[new], sim[new]
        order = np.lexsort((name, -sim, row))
        row, name, sim = row[order], name[order], sim[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < count
        return row[first], name[first], sim[first]

    def step(q, c, sim, state):
        names = c.groups if by_group else c.ids
        ends = np.searchsorted(state[0], np.arange(len(q.ids) + 1))
        full = np.diff(ends) == count
        floor = np.full(len(q.ids), -np.inf)
        floor[full] = state[2][ends[1:][full] - 1]
        some = sim >= floor[:, None] - SAME
        if np.count_nonzero(some) > 2 * count * len(q.ids):  # of each group its greatest, and whatever reaches the count-th value
            each = sim
            if by_group:
                begin = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))  # a block's rows lie by group
                each = np.maximum.reduceat(sim, begin, axis=1)
                some &= sim >= np.repeat(each, np.diff(np.append(begin, len(names))), axis=1) - SAME
            if count < each.shape[1]:
                some &= sim >= np.partition(each, each.shape[1] - count, axis=1)[:, each.shape[1] - count, None] - SAME
        row, col = np.nonzero(some)
        return tops(*(np.concatenate(x) for x in zip(state, (row, names[col], _products(q.vec, c.vec, row, col)), strict=True)))

    def start(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def finish(block, q, state):
        row, name, sim = state
        return _batch(["q", "id", "candidate", "sim"], np.full(len(row), block, np.int64), q.ids[row], name, sim)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(batches, start, step, finish)

    schema = "q long, id long, candidate long, sim double"
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "candidate")

    def ranked(found: DataFrame) -> DataFrame:
        if by_group:  # a group may lie in several blocks
            found = found.groupBy("q", "id", "candidate").agg(F.max("sim").alias("sim"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)

    if right.count() <= ONCE:
        return ranked(met(pairs, left, right).mapInArrow(best, schema))
    first = nearest_pairs(pairs, HEAD, F.col("most"))
    heads = stored(met(first, left, right).mapInArrow(best, schema), "first-lists")
    floors = ranked(heads).where(F.col("rank") == count).groupBy("q").agg(F.min("sim").alias("floor"), F.count("*").alias("full"))
    size = left.select(F.col("block").alias("q"), F.col("n").alias("q_n"))
    open_ = pairs.join(first.select("q", "c"), ["q", "c"], "left_anti").join(size, "q").join(floors, "q", "left")
    useless = (F.col("full") == F.col("q_n")) & (F.col("most") < F.col("floor") - SAME)
    rest = met(open_.where(~F.coalesce(useless, F.lit(False))), left, right).mapInArrow(best, schema)
    return ranked(heads.unionByName(rest))


def shortlist(queries: DataFrame, candidates: DataFrame, count: int) -> DataFrame:
    """The `count` most similar candidates of each query: id, candidate, sim, rank from 1; ties by candidate id."""
    return _shortlist(metric_index(queries), metric_index(candidates), count, by_group=False).select("id", "candidate", "sim", "rank")


def iou(a0: Column, a1: Column, b0: Column, b1: Column, inclusive: bool = False) -> Column:
    """Overlap over union of two spans, half-open or with inclusive ends."""
    one = 1 if inclusive else 0
    common = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + one, F.lit(0))
    union = (a1 - a0 + one) + (b1 - b0 + one) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def _best_of(v: np.ndarray, reach: int, count: int) -> tuple[np.ndarray, ...]:
    """row, rank from 0, start, end and mean of the best spans of up to `reach` places, as top_spans() has them."""
    n = v.shape[1]
    total, means, width, start = v, [], [], []
    for k in range(1, min(reach, n) + 1):
        if k > 1:
            total = total[:, :-1] + v[:, k - 1 :]
        means.append(np.round(total / k, 12))
        width.append(np.full(n - k + 1, k))
        start.append(np.arange(n - k + 1))
    mean, width, start = np.concatenate(means, axis=1), np.concatenate(width), np.concatenate(start)
    order = np.argsort(-mean, axis=1, kind="stable")[:, :count]  # columns: shorter first, then earlier; NaN last
    row, rank = np.nonzero(~np.isnan(np.take_along_axis(mean, order, axis=1)))
    col = order[row, rank]
    return row, rank, start[col], start[col] + width[col], mean[row, col]


def top_spans(scores: DataFrame, most: int, count: int) -> DataFrame:
    """Per id the `count` spans of greatest mean score, up to `most` places long: id, rank, start, end (exclusive), score.

    scores: id, values (array of doubles). Means are rounded to 12 digits; ties go to the shorter, then the earlier span.
    Spans over a null or NaN take no part. Cut a span of n places at any of its n - 1 inner places: one side has at
    least its mean. So n - 1 shorter spans come before it, and the best `count` have at most `count` places: longer ones
    are not formed. A list costs its length times min(most, count), and leaves `count` rows.
    """
    reach = min(most, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(np.asarray(lists.offsets))
            known = np.asarray(lists.is_valid())
            for n in np.unique(size[known & (size > 0)]).tolist():
                rows = np.flatnonzero(known & (size == n))
                for part in np.array_split(rows, -(-len(rows) * n * reach // (1 << 21))):
                    v = np.asarray(lists.take(pa.array(part)).flatten().cast(pa.float64()).fill_null(np.nan), float).reshape(len(part), n)
                    row, rank, begin, end, mean = _best_of(v, reach, count)
                    ids = b.column(0).take(pa.array(part[row]))
                    yield _batch(["id", "rank", "start", "end", "score"], ids, rank.astype(np.int32) + 1, begin.astype(np.int32), end.astype(np.int32), mean)

    kind = scores.schema["id"].dataType.simpleString()
    return scores.select("id", F.col("values").cast("array<double>")).mapInArrow(run, f"id {kind}, rank int, start int, end int, score double")


def pointing(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether the place of greatest score lies in the true span (id, gs, ge): id, place, hit."""
    top = F.array_max(F.transform("values", lambda v, i: F.struct(v.alias("v"), (-i).alias("j"))))
    places = scores.select("id", (-top["j"]).alias("place"))
    return places.join(truth, "id").select("id", "place", ((F.col("place") >= F.col("gs")) & (F.col("place") < F.col("ge"))).alias("hit"))


def span_recall(spans: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), bounds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """One row of recalls at K and overlap, and the mean overlap of the first span; a query without spans counts 0."""
    overlap = iou(F.col("start"), F.col("end"), F.col("gs"), F.col("ge"))
    joined = truth.join(spans, "id", "left").withColumn("iou", F.coalesce(overlap, F.lit(0.0)))
    per = joined.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("iou"))), F.lit(0.0)).alias(f"best_{k}") for k in ks])
    cells = [F.avg((F.col(f"best_{k}") >= b).cast("double")).alias(f"r{k}_iou{int(b * 10)}") for k in ks for b in bounds]
    return per.agg(F.count("*").alias("queries"), F.avg("best_1").alias("miou"), *cells)


def _whole(patches: DataFrame) -> DataFrame:
    """series, p: the vectors of a series in order of patch."""
    each = F.struct("patch", F.col("vec").cast("array<double>").alias("vec"))
    whole = patches.where(F.col("vec").isNotNull()).groupBy("series").agg(F.array_sort(F.collect_list(each)).alias("p"))
    return whole.select("series", F.col("p.vec").alias("p"))


def patch_scores(queries: DataFrame, patches: DataFrame) -> DataFrame:
    """Dot products of each query's vector with the patches of its series: id, series, values in order of patch.

    queries: id, series, vec; patches: series, patch, vec. A series' patches travel as one packed row.
    """

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, lists = unit_rows(b.column(2)), b.column(3)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            p = unit_rows(lists.flatten())
            each = np.einsum("ij,ij->i", np.repeat(q, np.diff(ends), axis=0), p)
            yield _batch(["id", "series", "values"], b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each)))

    queries = queries.where(F.col("vec").isNotNull())
    joined = queries.select("id", "series", F.col("vec").cast("array<double>").alias("vec")).join(_whole(patches), "series")
    return joined.select("id", "series", "vec", "p").mapInArrow(dots, "id long, series long, values array<double>")


def _spans_by_pair(asked: DataFrame, queries: DataFrame, patches: DataFrame, most: int) -> DataFrame:
    """id, series, start, end, score of the best span of each query and series of its list; vectors go to the series."""
    pairs = asked.select("series", F.explode("asked").alias("id")).join(queries.select("id", "vec"), "id")
    pair = patch_scores(pairs, patches).select(F.struct("id", "series").alias("id"), "values")
    return top_spans(pair, most, 1).select("id.id", "id.series", "start", "end", "score")


def _spans_by_band(asked: DataFrame, left: DataFrame, patches: DataFrame, count: int) -> DataFrame:
    """As _spans_by_pair(), where the queries of a band share series: a series goes to a band once. Of a query's spans
    the `count` best of each part are left. (The best span of all has one place: see top_spans().)"""
    names = ["id", "series", "start", "end", "score"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b.column(1)[i].values for i in range(b.num_rows)]
            single, data = zip(*(to_bytes(matrix(p)) for p in rows), strict=True) if rows else ((), ())
            yield _batch(["block", "n", "single", "data"], b.column(0), pa.array([len(p) for p in rows], pa.int32()), pa.array(single, pa.bool_()), pa.array(data, pa.binary()))

    def best(ids: np.ndarray, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            cells = [np.concatenate(x) for x in zip(*found, strict=True)]
            order = np.lexsort((cells[1], -cells[4], cells[0]))
            at = cells[0][order]
            order = order[np.arange(len(at)) - np.searchsorted(at, at) < count]
            at, series, begin, end, score = (x[order] for x in cells)
            yield _batch(names, ids[at], series, begin.astype(np.int32), end.astype(np.int32), score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vec, found, waiting = None, np.zeros(0, np.int64), np.zeros((0, 0)), [], {}

        def decide() -> None:
            for each in waiting.values():  # series of as many patches
                rows, series, values = (np.concatenate(x) for x in zip(*each, strict=True))
                row, _, begin, end, score = _best_of(values, 1, 1)
                found.append((rows[row], series[row], begin, end, score))
            waiting.clear()

        for b in batches:
            ends, asked = np.asarray(b.column("asked").offsets), np.asarray(b.column("asked").values)
            band_rows = np.asarray(b.column("asked").is_null())
            for i in range(b.num_rows):
                new = (b.column("band")[i].as_py(), b.column("part")[i].as_py())
                if new != key:
                    decide()
                    yield from best(ids, found)
                    key, sides, found = new, [], []
                if band_rows[i]:
                    sides.append(Side(b, i))
                    continue
                if sides:
                    ids, vec = np.concatenate([s.ids for s in sides]), np.concatenate([s.vec for s in sides])
                    order = np.argsort(ids, kind="stable")
                    ids, vec, sides = ids[order], vec[order], []
                rows = np.searchsorted(ids, asked[ends[i] : ends[i + 1]])
                n = b.column("n")[i].as_py()
                p = unit(from_bytes(n, b.column("single")[i].as_py(), b.column("data")[i].as_py()))
                waiting.setdefault(n, []).append((rows, np.full(len(rows), b.column("block")[i].as_py(), np.int64), vec[rows] @ p.T))
            decide()
        yield from best(ids, found)

    parts = part_count(left, 0)
    packs = _whole(patches).select(F.col("series").cast("long"), "p").mapInArrow(packed, "block long, n int, single boolean, data binary")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("series"), F.lit(parts)).cast("int")).withColumnRenamed("series", "block")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "groups", "sims", "ats")]
    series = dealt.join(packs, "block").select("band", "part", "asked", "block", "n", *none, "single", "data")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    own = left.select(band(F.col("block")).alias("band"), part, F.lit(None).cast("array<bigint>").alias("asked"), "block", "n", "ids", "groups", "sims", "ats", "single", "data")
    return banded(own.unionByName(series)).mapInArrow(run, "id long, series long, start int, end int, score double")


def corpus_grounding(queries: DataFrame, series: DataFrame, patches: DataFrame, near: int = 50, most: int = 32, count: int = 5) -> DataFrame:
    """Two stages: the `near` most similar series of a query, the best span in each, then the `count` best of these:
    id, rank, series, start, end, score. Ids are unique.

    Queries and the series of their lists meet in bands of queries if that moves fewer vectors than pair by pair."""
    left = metric_index(queries)
    chosen = _shortlist(left, metric_index(series), near, by_group=False)
    lists = chosen.groupBy(band(F.col("q")).alias("band"), F.col("candidate").alias("series")).agg(F.collect_list("id").alias("asked"))
    asked = stored(lists, "asked")
    sent = asked.agg(F.count("*").alias("lists"), F.sum(F.size("asked")).alias("pairs")).first()
    size = patches.agg((F.count("*") / F.greatest(F.approx_count_distinct("series"), F.lit(1))).alias("n")).first()["n"]
    if sent.lists * size <= (sent.pairs or 0):
        best = _spans_by_band(asked, left, patches, count)
    else:
        best = _spans_by_pair(asked, queries, patches, most)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "series")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def best_patch_shortlist(queries: DataFrame, patches: DataFrame, count: int) -> DataFrame:
    """The `count` series of greatest single patch similarity: id, series, sim, rank. Patches: id, group_key (the
    series, a number), vec. A pair of blocks leaves at most `count` series a query."""
    best = _shortlist(metric_index(queries), metric_index(patches, by_group=True), count, by_group=True)
    return best.select("id", F.col("candidate").alias("series"), "sim", "rank")


def span_embedding(spans: DataFrame, patches: DataFrame) -> DataFrame:
    """Mean vector of the patches in each span [ps, pe): span_id, dim, value. Long spans' patches are found by an
    equality join on (series, patch)."""
    each = spans.select("span_id", "series", F.explode(F.sequence(F.col("ps"), F.col("pe") - 1)).alias("patch"))
    dims = each.join(patches, ["series", "patch"]).select("span_id", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    return dims.groupBy("span_id", "dim").agg(F.avg("x").alias("value"))
