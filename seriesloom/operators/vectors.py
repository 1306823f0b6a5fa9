"""A metric index of unit vectors as a table: blocks of neighbouring vectors, each with a pivot and an angular radius.

If two blocks' pivots are at an angle t and their radii are a and b, every product of their vectors lies between
cos(t + a + b) and cos(t - a - b). A search compares these bounds with what it already knows and looks only at the
pairs of blocks that may still change a result; vectors travel as packed bytes, and a pair leaves a bounded number of
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Vectors of a block; vectors from which the cells' centres are fitted, their number and rounds of fitting.
BLOCK, SAMPLE, CELLS, ROUNDS = 1024, 4096, 64, 5
#: Angles are widened by this, far above the rounding of the cosine of nearly equal vectors.
SLACK = 1e-6
#: Similarities this close are equal.
SAME = 1e-12
#: Parts over which pairs of blocks are formed; parts of the candidates of a band, up to which they only serve to occupy
#: all cores, and candidate blocks of a part beyond which there are more.
SLOTS, PARTS, LONG = 64, 8, 256
#: A band is up to 1 << BAND neighbouring query blocks, to which a candidate block travels once.
BAND = 5

SCHEMA = "block long, n int, ids binary, groups binary, sims binary, ats binary, low double, high double, pivot array<double>, radius double, single boolean, data binary"


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors (of one length) as rows."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """The rows at unit length; the norm is at least 1e-8."""
    return m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-8)[:, None]


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors (of one length) at unit length."""
    return unit(matrix(column))


def to_bytes(m: np.ndarray) -> tuple[bool, bytes]:
    """Whether single precision holds the numbers exactly, and their bytes in it or in double precision."""
    with np.errstate(over="ignore"):
        short = m.astype(np.float32)
    single = bool((short == m).all())
    return single, (short if single else m).tobytes()


def from_bytes(n: int, single: bool, data: bytes) -> np.ndarray:
    """The n rows of to_bytes() in double precision."""
    return np.frombuffer(data, np.float32 if single else float).astype(float).reshape(n, -1)


def _centres(rows: DataFrame) -> np.ndarray:
    """Directions around which the vectors lie, from at most SAMPLE of them (those of the least hash). They only decide
    which vectors share a block."""
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    unit = np.unique(unit_rows(sample), axis=0) if len(sample) else np.zeros((0, 0))
    centres = unit[:: max(1, len(unit) // CELLS)][:CELLS]
    for _ in range(ROUNDS if len(centres) else 0):
        total = np.zeros_like(centres)
        np.add.at(total, (unit @ centres.T).argmax(axis=1), unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    chain, left = [0] if len(centres) else [], set(range(1, len(centres)))
    while left:  # neighbours get neighbouring numbers, as a block may take rows of several cells
        near = max(left, key=lambda c: float(centres[c] @ centres[chain[-1]]))
        chain.append(near)
        left.discard(near)
    return centres[chain]


def _celled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("cell", pa.array((unit_rows(b.column("vec")) @ centres.T).argmax(axis=1), pa.int32()))


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number, names = TaskContext.get().partitionId() << 32, [f.split()[0] for f in SCHEMA.split(", ")]
    held: list[pa.RecordBatch] = []

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = matrix(b.column("vec"))
        even = unit(rows)
        centre = even.sum(axis=0)
        pivot = centre / max(np.linalg.norm(centre), 1e-8)
        radius = float(np.arccos(np.clip(even @ pivot, -1, 1)).max()) + SLACK
        sims, ats = np.asarray(b.column("sim"), float), np.asarray(b.column("at"), np.int64)
        packed = [np.asarray(b.column(c), np.int64).tobytes() for c in ("id", "grp")]
        row = [number, len(rows), *packed, sims.tobytes(), ats.tobytes(), float(sims.min()), float(sims.max()), pivot.tolist(), radius, *to_bytes(rows)]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            whole = pa.concat_batches(held)
            mark = np.stack([np.asarray(whole.column(c)[:size]) for c in ("grp", "cell")])
            ends = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1
            cut = int(ends[-1]) if len(ends) and ends[-1] >= size / 2 else size  # at the end of a cell, if one is near
            yield block(whole.slice(0, cut))
            held, number = [whole.slice(cut)], number + 1
    if sum(b.num_rows for b in held):
        yield block(pa.concat_batches(held))


def metric_index(rows: DataFrame, by_group: bool = False) -> DataFrame:
    """The blocks of `rows` (id long, group_key, vec array of doubles of one length; sim and at where a search needs
    them), stored. Blocks hold BLOCK / 2 to BLOCK vectors of neighbouring cells; with by_group, of a group and then of a cell.

    Rows without an id or vector are left out. Large cells and groups are split by id.
    """
    number = F.col("group_key").cast("long") if dict(rows.dtypes)["group_key"] in ("int", "bigint") else F.xxhash64("group_key")
    extra = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in ("sim", "at")]
    base = rows.select("id", number.alias("grp"), "vec", *extra).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    base = base.select(F.col("id").cast("long"), F.coalesce("grp", F.lit(0)).cast("long").alias("grp"), F.col("vec").cast("array<double>"), F.col("sim").cast("double"), F.col("at").cast("long"))
    centres = _centres(base)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    celled = base.mapInArrow(lambda b: _celled(b, centres), "id long, grp long, vec array<double>, sim double, at long, cell int")
    size = BLOCK
    order = [*(["grp"] if by_group else []), "cell"]
    return stored(celled.repartitionByRange(*order, "id").sortWithinPartitions(*order).mapInArrow(lambda b: _packed(b, size), SCHEMA), "vectors")


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every pair of blocks with its bounds: q, c (block numbers), q_low, q_high, c_n, least and most product."""
    left = queries.select(F.col("block").alias("q"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("pivot").alias("qp"), F.col("radius").alias("qr"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    right = candidates.select(F.col("block").alias("c"), F.col("n").alias("c_n"), F.col("pivot").alias("cp"), F.col("radius").alias("cr"), F.pmod(F.xxhash64("block"), F.lit(SLOTS)).cast("int").alias("slot"))
    dot = F.aggregate(F.zip_with("qp", "cp", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    angle, wide = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))), F.col("qr") + F.col("cr") + SLACK
    pairs = left.join(right, "slot").withColumn("angle", angle)
    least, most = F.cos(F.least(F.col("angle") + wide, F.lit(np.pi))), F.cos(F.greatest(F.col("angle") - wide, F.lit(0.0)))
    return pairs.select("q", "c", "q_low", "q_high", "c_n", least.alias("least"), most.alias("most"))


def band(block: Column) -> Column:
    """The band of a block: its number without the last bits. Tasks number their blocks from multiples of 1 << 32."""
    return F.shiftright(block, BAND)


def part_count(queries: DataFrame, candidates: int) -> int:
    """Parts of the candidates (a number of blocks) of a band of `queries`: few, as each sends the band once more, but
    enough for all cores, and for tasks that do not grow with the candidates."""
    bands = queries.select(band(F.col("block")).alias("band")).distinct().count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, min(PARTS, -(-2 * cores // max(bands, 1))), -(-candidates // LONG))


def banded(rows: DataFrame) -> DataFrame:
    """Rows of a band and part one after another in one task, those of the band (asked is null) first."""
    return rows.repartition("band", "part").sortWithinPartitions("band", "part", F.col("asked").isNotNull())


def met(pairs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs (q, c) with both blocks' contents, for folded(): of each band and part of the candidates the query
    blocks, then the candidate blocks with the numbers of the query blocks that ask for them."""
    content = ["n", "ids", "groups", "sims", "ats", "single", "data"]
    part = F.pmod(F.xxhash64("c"), F.lit(part_count(queries, candidates.count()))).cast("int").alias("part")
    asked = pairs.select(band(F.col("q")).alias("band"), part, "c", "q").groupBy("band", "part", "c").agg(F.collect_set("q").alias("asked"))
    right = asked.join(candidates.select(F.col("block").alias("c"), *content), "c").withColumnRenamed("c", "block")
    left = asked.select("band", "part", F.explode("asked").alias("block")).distinct().join(queries.select("block", *content), "block")
    return banded(left.withColumn("asked", F.lit(None).cast("array<bigint>")).unionByName(right))


class Side:
    """One block's contents: ids, groups, known similarities and their candidates, vectors."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        self.ids, self.groups, self.ats = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("ids", "groups", "ats"))
        self.sims = np.frombuffer(b.column("sims")[i].as_py(), float)
        self.vec = unit(from_bytes(len(self.ids), b.column("single")[i].as_py(), b.column("data")[i].as_py()))


def folded(batches: Iterator[pa.RecordBatch], start: Callable, step: Callable, finish: Callable) -> Iterator[pa.RecordBatch]:
    """One result for each query block of a band and part: finish(block, its contents, state) after
    state = step(contents, candidate block's contents, their products, state) over its pairs, from start(contents)."""
    key, held = None, {}
    for b in batches:
        for i in range(b.num_rows):
            new = (b.column("band")[i].as_py(), b.column("part")[i].as_py())
            if new != key:
                yield from (finish(block, q, state) for block, (q, state) in held.items())
                key, held = new, {}
            asked, side = b.column("asked")[i].as_py(), Side(b, i)
            if asked is None:
                held[b.column("block")[i].as_py()] = side, start(side)
            for block in asked or []:
                q, state = held[block]
                held[block] = q, step(q, side, q.vec @ side.vec.T, state)
    yield from (finish(block, q, state) for block, (q, state) in held.items())


def nearest_pairs(pairs: DataFrame, count: int, order: Column) -> DataFrame:
    """Of each query block, the `count` pairs of greatest bound."""
    best = pairs.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(order.alias("o"), "c")))), 1, count).alias("best"))
    return best.select("q", F.explode("best.c").alias("c"))
