"""Hard negatives by exact inner-product search over lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within an angle b of it, a row x at
angle t from c has with any member a at most the product |a| |x| cos(max(0, t - b)). A task sorts the rows of its
shard by that bound once for a cluster, and every member walks the list from the top until the bound certifies that
no row further down can matter. Whole shards whose greatest bound is too small for a block of anchors are never sent
to it. A first walk over each cluster's most promising shards gives floors for the other walks.

Scores are sums of integer products, exact at any size that a long holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a shard and anchors of a block, both packed as one row of bytes.
SHARD_ROWS, BLOCK_ROWS = 8192, 256
#: Anchors from which the centres are fitted (those of the least hash), and rounds of fitting. Centres change the work alone.
SAMPLE, ROUNDS = 4096, 8
#: Shards of a cluster's list that the first walk covers, and rows of a list between two looks at the bound.
HEAD, STEP = 2, 1024
#: Angles and bounds are enlarged by these, far above the rounding of doubles.
ANGLE_SLACK, BOUND_SLACK = 1e-6, 1e-9
_INTS = (np.int8, np.int16, np.int32, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled up with zeros."""
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _pad(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact; an error if one does not fit into 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = _pad(a, width), _pad(b, width)
    most = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    if width * most(a) * most(b) < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.array(a.astype(object) @ b.astype(object).T, np.int64).reshape(len(a), len(b))


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length (a zero row stays) and their norms."""
    m = m.astype(float)
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = max(unit.shape[1], centres.shape[1])
    return np.arccos(np.clip(_pad(unit, width) @ _pad(centres, width).T, -1, 1))


def _packed(m: np.ndarray) -> tuple[int, int, bytes]:
    """Width, bytes of a component, and the matrix in the narrowest integers that hold it."""
    kind = next(k for k in _INTS if m.size == 0 or (m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max))
    return m.shape[1], np.dtype(kind).itemsize, m.astype(kind).tobytes()


def _unpacked(rows: int, width: int, item: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{item}").reshape(rows, width).astype(np.int64)


def _centres(anchors: DataFrame, clusters: int) -> np.ndarray:
    """Unit centres of the anchors' directions, by spherical k-means on at most SAMPLE anchors."""
    sample = anchors.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    unit, _ = _unit(_matrix(sample)) if len(sample) else (np.zeros((0, 0)), None)
    unit = np.unique(unit, axis=0)
    chosen = unit[:: max(1, len(unit) // clusters)][:clusters] if len(unit) else unit
    for _ in range(ROUNDS if len(chosen) else 0):
        near = (unit @ chosen.T).argmax(axis=1)
        total = np.zeros_like(chosen)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        chosen = np.where(size > 0, total / np.where(size > 0, size, 1), chosen)
    return chosen


def _celled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("cell", pa.array(_angles(_unit(_matrix(b.column(2)))[0], centres).argmin(axis=1), pa.int32()))


BLOCK = "block long, cluster int, n int, spread double, rows binary, ids binary, no_id binary, labels binary, width int, item int, data binary"
SHARD = "shard long, n int, ids binary, no_id binary, labels binary, width int, item int, data binary, bounds array<struct<cluster: int, angle: double, most: double>>"


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of exactly `most`, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= most:
            whole = pa.concat_batches(held)
            yield whole.slice(0, most)
            held = [whole.slice(most)]
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _ids(column: pa.Array) -> tuple[bytes, bytes]:
    return np.asarray(column.fill_null(0), np.int64).tobytes(), np.asarray(column.is_null()).tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], centres: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Anchors by nearest centre, packed in blocks; each anchor gets a number of its own."""
    part, number = TaskContext.get().partitionId() << 40, 0
    for batch in _runs(batches, 16 * size):
        m = _matrix(batch.column(2))
        angle = _angles(_unit(m)[0], centres)
        near = angle.argmin(axis=1)
        out = []
        for c in np.unique(near).tolist():
            own = np.flatnonzero(near == c)
            for at in range(0, len(own), size):
                rows = own[at : at + size]
                some = batch.take(pa.array(rows))
                ids, no_id = _ids(some.column(0))
                width, item, data = _packed(m[rows])
                out.append((part + number, c, len(rows), float(angle[rows, c].max()), (part + number + np.arange(len(rows))).tobytes(), ids, no_id, np.asarray(some.column(1), np.int64).tobytes(), width, item, data))
                number += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.binary()), strict=True)], [x.split()[0] for x in BLOCK.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], centres: np.ndarray, spread: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Rows packed in shards, each with its greatest bound (less the anchor's norm) for every cluster."""
    part, number = TaskContext.get().partitionId() << 32, 0
    names = ["shard", "n", "ids", "no_id", "labels", "width", "item", "data", "bounds"]
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("angle", pa.float64()), ("most", pa.float64())]))
    for batch in _runs(batches, size):
        m = _matrix(batch.column(2))
        bound = bounds(m, centres, spread)
        each = [{"cluster": c, "angle": float(spread[c]), "most": float(bound[:, c].max())} for c in range(len(centres)) if spread[c] >= 0]
        width, item, data = _packed(m)
        ids, no_id = _ids(batch.column(0))
        row = (part + number, len(m), ids, no_id, np.asarray(batch.column(1), np.int64).tobytes(), width, item, data, each)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), kind), strict=True)], names)
        number += 1


def bounds(m: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For every row and cluster, at least the greatest product with a member of the cluster over the member's norm."""
    unit, norm = _unit(m)
    off = np.maximum(0, _angles(unit, centres) - spread[None, :] - ANGLE_SLACK)
    return norm[:, None] * (np.cos(np.minimum(off, np.pi)) + BOUND_SLACK)


def _top(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, equal ones by ascending id, rows without an id last."""
    if len(scores) > 4 * k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return place[np.lexsort((ids[place], no_id[place], -scores[place]))][:k]
    return np.lexsort((ids, no_id, -scores))[:k]


class List:
    """One shard's part of the list that a cluster's members share: its rows by falling bound."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, no_id: np.ndarray, labels: np.ndarray, bound: np.ndarray) -> None:
        order = np.argsort(-bound, kind="stable")
        self.bound, self.m, self.ids, self.no_id, self.labels = bound[order], m[order], ids[order], no_id[order], labels[order]

    def keys(self) -> pa.Array:
        return pa.array(self.ids, mask=self.no_id)


class Walk:
    """The members of a block of anchors on a list, and what each member keeps."""

    def __init__(self, anchors: np.ndarray, labels: np.ndarray, rows: List, step: int = STEP) -> None:
        self.anchors, self.own, self.norm, self.list = anchors, labels, _unit(anchors)[1], rows
        self.step = step
        self.walked = np.zeros(len(anchors), np.int64)

    def steps(self, floor: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """(members still walking, places of the list, their scores). A member stops when the bound of the next place
        times its norm is below floor[member], which the caller raises meanwhile."""
        for at in range(0, len(self.list.bound), self.step):
            going = np.flatnonzero(self.norm * self.list.bound[at] >= floor)
            if not len(going):
                return
            part = slice(at, min(at + self.step, len(self.list.bound)))
            self.walked[going] += part.stop - at
            yield going, part, products(self.anchors[going], self.list.m[part])

    def positives(self, k: int, floor: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Of each member, places and scores of its k best rows of the same label."""
        floor = floor.copy()
        kept = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in self.anchors]
        for going, part, scores in self.steps(floor):
            hit = (self.list.labels[part][None, :] == self.own[going][:, None]) & (scores >= floor[going][:, None])
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                i, new = int(going[r]), np.flatnonzero(hit[r])
                kept[i][0] = self._merge(kept[i][0], new + part.start, scores[r, new], k)
                if len(kept[i][0][0]) == k:
                    floor[i] = max(floor[i], kept[i][0][1][-1])
        return kept

    def negatives(self, k: int, tops: list[np.ndarray], percent: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Of each member and each of its positive scores `tops`, places and scores of the k best rows of other labels
        that score at most the top and at least `percent` per cent of it."""
        lows = [-(-percent * t // 100) for t in tops]
        kept = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in t] for t in tops]
        floor = np.array([float(x.min()) if len(x) else np.inf for x in lows])
        for going, part, scores in self.steps(floor):
            other = self.list.labels[part][None, :] != self.own[going][:, None]
            for r in range(len(going)):
                i = int(going[r])
                place = np.flatnonzero(other[r] & (scores[r] >= floor[i]))
                if not len(place):
                    continue
                need, near = [], scores[r, place]
                for j, (top, low) in enumerate(zip(tops[i].tolist(), lows[i].tolist(), strict=True)):
                    new = (near <= top) & (near >= low)
                    if new.any():
                        kept[i][j] = self._merge(kept[i][j], place[new] + part.start, near[new], k)
                    need.append(max(low, int(kept[i][j][1][-1])) if len(kept[i][j][1]) == k else low)
                floor[i] = min(need)
        return kept

    def _merge(self, kept: tuple[np.ndarray, np.ndarray], place: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        place, scores = np.concatenate((kept[0], place)), np.concatenate((kept[1], scores))
        best = _top(scores, self.list.ids[place], self.list.no_id[place], k)
        return place[best], scores[best]


FOUND = "block long, anchor long, anchor_id long, no_anchor_id boolean, own long, place int, id long, score long, walked long"


def _walks(batches: Iterator[pa.RecordBatch], centres: np.ndarray, spread: np.ndarray, k: int, percent: int | None, step: int) -> Iterator[pa.RecordBatch]:
    """Every pair of block and shard walked: the members' best rows of the same label, or with `percent` their best
    rows of other labels for each positive (place: which of them)."""
    shard, lists = None, {}
    for b in batches:
        for i in range(b.num_rows):
            get = lambda n: b.column(n)[i].as_py()  # noqa: B023, E731
            c, n = get("cluster"), get("n")
            if get("shard") != shard:
                shard, lists = get("shard"), {}
            if c not in lists:  # sorted once for all blocks of the cluster
                m = _unpacked(get("s_n"), get("s_width"), get("s_item"), get("s_data"))
                lists[c] = List(m, np.frombuffer(get("s_ids"), np.int64), np.frombuffer(get("s_no_id"), bool), np.frombuffer(get("s_labels"), np.int64), bounds(m, centres[c : c + 1], spread[c : c + 1])[:, 0])
            anchors, rows = _unpacked(n, get("width"), get("item"), get("data")), np.frombuffer(get("rows"), np.int64).tolist()
            walk = Walk(anchors, np.frombuffer(get("labels"), np.int64), lists[c], step)
            known = {x["anchor"]: x["scores"] for x in get("known") or []}
            if percent is None:
                kept = walk.positives(k, np.array([known.get(r, [-np.inf])[0] for r in rows], float))
            else:
                kept = walk.negatives(k, [np.array(known.get(r, []), np.int64) for r in rows], percent)
            full = [(x, j) for x in range(n) for j in range(len(kept[x])) if len(kept[x][j][0])]
            if not full:
                continue
            who, size = np.array([x for x, _ in full]), np.array([len(kept[x][j][0]) for x, j in full])
            each = lambda values, kind: pa.array(np.repeat(np.asarray(values), size), kind)  # noqa: B023, E731
            own = [int(products(anchors[x : x + 1], anchors[x : x + 1])[0, 0]) for x in who]
            ids, no_id = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("no_id"), bool)
            columns = [each([get("block")] * len(full), pa.int64()), each(np.array(rows)[who], pa.int64()), each(ids[who], pa.int64()), each(no_id[who], pa.bool_()), each(own, pa.int64()), each([j for _, j in full], pa.int32())]
            columns += [lists[c].keys().take(pa.array(np.concatenate([kept[x][j][0] for x, j in full]))), pa.array(np.concatenate([kept[x][j][1] for x, j in full])), each(walk.walked[who], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _met(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, known: DataFrame | None) -> DataFrame:
    """The pairs (block, shard) with all that a walk needs."""
    if known is not None:
        blocks = blocks.join(known.select("block", "known"), "block", "left")
    else:
        blocks = blocks.withColumn("known", F.lit(None).cast("array<struct<anchor: bigint, scores: array<bigint>>>"))
    others = shards.select("shard", *[F.col(c).alias(f"s_{c}") for c in ("n", "ids", "no_id", "labels", "width", "item", "data")])
    return pairs.select("block", "shard").join(blocks, "block").join(others, "shard")


def _mined(blocks: DataFrame, shards: DataFrame, centres: np.ndarray, spread: np.ndarray, positives: int, negatives: int, percent: int) -> DataFrame:
    step = STEP
    k = positives + 1  # the anchor itself is among the rows of its label

    def walk(pairs: DataFrame, known: DataFrame | None, keep: int, share: int | None) -> DataFrame:
        return _met(pairs, blocks, shards, known).mapInArrow(lambda b: _walks(b, centres, spread, keep, share, step), FOUND)

    lists = shards.select("shard", F.explode("bounds").alias("x")).select("shard", "x.cluster", "x.most")
    lists = lists.withColumn("turn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("most"), "shard")))
    pairs = lists.join(blocks.select("block", "cluster", "n"), "cluster")
    first = stored(walk(pairs.where(F.col("turn") <= HEAD), None, k, None), "first-walks")
    reach = F.col("score") / F.sqrt(F.col("own").cast("double"))
    floors = _ranked(first, ["anchor"], k).where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("anchor", F.array("score").alias("scores"))).alias("known"), F.count("*").alias("bounded"), F.min(F.when(F.col("own") > 0, reach).otherwise(float("-inf"))).alias("reach"))
    useless = (F.col("bounded") == F.col("n")) & (F.col("most") < F.col("reach"))
    further = pairs.where(F.col("turn") > HEAD).join(floors.drop("known"), "block", "left").where(~F.coalesce(useless, F.lit(False)))
    found = first.unionByName(walk(further, floors, k, None))

    best = _ranked(found, ["anchor"], k).groupBy("block", "anchor", "anchor_id", "no_anchor_id", "own").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    me = F.when(F.col("no_anchor_id"), F.lit(None)).otherwise(F.col("anchor_id"))
    itself = F.array_position(F.transform("best", lambda x: x["id"].eqNullSafe(me) & (x["score"] == F.col("own"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("itself")), 1, positives)
    tops = best.withColumn("itself", itself).select("block", "anchor", me.alias("anchor_id"), "own", others.alias("others")).where(F.size("others") > 0)
    tops = stored(tops, "positives")
    low = F.array_min(F.transform("others", lambda x: F.floor(x["score"] * F.lit(float(percent)) / 100) - 1))
    known = tops.groupBy("block").agg(F.collect_list(F.struct("anchor", F.col("others.score").alias("scores"))).alias("known"), F.min(F.when(F.col("own") > 0, low / F.sqrt(F.col("own").cast("double"))).otherwise(float("-inf"))).alias("reach"))
    useful = pairs.join(known.drop("known"), "block").where(F.col("most") >= F.col("reach"))
    chosen = _ranked(walk(useful, known, negatives, percent), ["anchor", "place"], negatives).select("anchor", "place", "rank", "id", "score")
    each = tops.select("anchor", "anchor_id", F.posexplode("others").alias("place", "p"))
    out = each.join(chosen, ["anchor", "place"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, percent: int = 80, clusters: int = 32) -> DataFrame:
    """For each anchor (rows for which `anchor` holds) and each of its `positives` best other rows of its label: the
    first `negatives` rows of other labels whose score is at most the positive's and at least `percent` per cent of
    it. anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows[vector]: array of longs without nulls; a score is the inner product with the anchor, higher ones first, equal
    ones by ascending key (null keys last). Vectors of other lengths are compared as if filled up with zeros. Rows with
    a null label or vector take no part. Repeated rows and keys are rows of their own, as anchors too. No anchors,
    no rows of the label or none in the range give no rows; other columns are not read. A product beyond 64 bits is an
    error. Every row is searched: bounds leave out only what they prove to be of no use.
    """
    base = rows.select(rows[key].cast("long").alias("id"), rows[label].cast("long").alias("label"), rows[vector].cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = base.where(F.col("label").isNotNull() & F.col("vec").isNotNull())
    anchors = base.where("anchor").select("id", "label", "vec")
    centres = _centres(anchors, clusters)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], RESULT)
    block_rows, shard_rows = BLOCK_ROWS, SHARD_ROWS
    blocks = stored(anchors.mapInArrow(lambda b: _blocks(b, centres, block_rows), BLOCK), "anchor-blocks")
    spread = np.full(len(centres), -1.0)
    for r in blocks.groupBy("cluster").agg(F.max("spread").alias("s")).collect():  # at most a row a cluster
        spread[r.cluster] = r.s

    celled = base.select("id", "label", "vec").mapInArrow(lambda b: _celled(b, centres), "id long, label long, vec array<long>, cell int")
    dealt = celled.repartitionByRange("cell", "id").sortWithinPartitions("cell").drop("cell")  # neighbours lie in one shard
    shards = stored(dealt.mapInArrow(lambda b: _shards(b, centres, spread, shard_rows), SHARD), "shards")
    return _mined(blocks, shards, centres, spread, positives, negatives, percent)
