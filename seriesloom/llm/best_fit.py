"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Documents in order of falling length go one by one to the open sequence with the least room that still holds them;
a segment tree over remaining capacities finds it. Documents of one length are alike to this rule, so it needs the
number of documents of each length alone, a table of at most `window` rows whatever the corpus: runs of documents
of a length are given to runs of sequences with the same room, one search of the tree a run. The plan is that of one
sequential pass over the whole corpus. Which document is the i-th of its length comes from a stored table, in which
each document is numbered within its task, and from sums of the tasks' counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import chunks, encoder, with_ends

#: Length and rank as one number: length * RANKS + rank.
RANKS = 1 << 45


class CapacityTree:
    """Open sequences by remaining capacity: runs (first sequence, number of sequences) at the leaves of a segment
    tree whose inner nodes say whether any sequence below is open. tightest() takes logarithmic time."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int) -> None:
        node, state = room + self.leaves, bool(self.runs[room])
        while node and self.open[node] != state:
            self.open[node] = state
            node >>= 1
            state = bool(self.open[2 * node] or self.open[2 * node + 1])

    def add(self, room: int, first: int, number: int) -> None:
        """Opens sequences first .. first + number - 1, each with this room; full ones are left out."""
        if room and number:
            self.runs[room].append((first, number))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        """Removes and gives one run of sequences with exactly this room."""
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open sequence that is at least `need`."""
        node = need + self.leaves
        while not self.open[node]:
            while node & 1:  # a right child: nothing further right below the same parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.open[2 * node])
        return node - self.leaves


def best_fit_plan(counts: Mapping[int, int], window: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, documents a sequence, offset of the first) of the plan, ascending.

    The document of this length with rank r, first rank <= r < next row's, lies in sequence
    first + (r - first rank) // each at offset + (r - first rank) % each * length. A run leaves less than half of a
    sequence's room, so sequences are met at most log2(window) times; the plan has at most a few rows for each
    length and each power of two.
    """
    tree, rows, sequences = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = window, sequences, -(-left // (window // length))
                sequences += number
            else:
                first, number = tree.take(room)
            each = room // length
            whole = min(number, left // each)
            if whole:
                rows.append((length, rank, first, each, window - room))
                tree.add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < number:  # one more sequence takes what is left, less than it could
                rows.append((length, rank, first + whole, each, window - room))
                tree.add(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            tree.add(room, first + whole, number - whole)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Every document's pieces, each numbered among the pieces of its length in this task."""
    enc, part = encoder(vocabulary), TaskContext.get().partitionId()
    seen = np.zeros(window + 1, np.int64)
    for batch in chunks(batches, 1):
        ids, offsets = with_ends(*enc.encode(batch.column(1)), end_id)
        size = np.diff(offsets)
        number = -(-size // window)
        doc = np.repeat(np.arange(len(size)), number)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        head = (size - (number - 1) * window)[doc]
        start = np.where(piece == 0, 0, head + (piece - 1) * window)
        length = np.where(piece == 0, head, window)
        order = np.argsort(length, kind="stable")
        new = np.bincount(length, minlength=window + 1)
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(new) - new, new)
        place += seen[length]
        seen += new
        begin = offsets[:-1][doc] + start
        raw = memoryview(np.ascontiguousarray(ids)).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)], pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
        names = ["k", "piece", "start", "length", "ids_crc32", "part", "place"]
        if with_ids:  # pieces follow one another as the documents' ids do
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def best_fit_pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids (each document's followed by `end_id`) in as few sequences of at most `window` ids
    as best-fit decreasing finds: key, piece, start, length, ids_crc32, sequence_id, offset; also the piece's ids if
    asked for.

    A document of at most `window` ids is one piece; a longer one is cut into pieces of `window` ids behind a first
    piece of what remains. Sequences are numbered from 0. A null text is empty and has the end id alone; repeated rows
    and null keys are packed as further documents; an empty table gives no rows; other columns of `docs` are not read.
    The driver holds a row a length; a shuffle moves rows of numbers (and the ids if asked for), no texts.
    """
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    schema = "k long, piece int, start long, length long, ids_crc32 long, part int, place long" + (", ids array<int>" if with_ids else "")
    pieces = stored(rows.mapInArrow(lambda b: _pieces(b, vocabulary, window, end_id, with_ids), schema), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row a length
    plan = best_fit_plan(counts, window)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = plan[:, 0] * RANKS + plan[:, 1]
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            _, rank0, sequence, number, offset = plan[np.searchsorted(first, length * RANKS + rank, side="right") - 1].T
            turn, inside = np.divmod(rank - rank0, number)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in own], pa.array(sequence + turn), pa.array(offset + inside * length)], [*own, "sequence_id", "offset"])

    own = [c for c in pieces.columns if c not in ("part", "place")]
    ranked = pieces.join(base, ["length", "part"]).select(*own, (F.col("place") + F.col("base")).alias("rank"))
    out = ranked.mapInArrow(placed, schema.replace(", part int, place long", "") + ", sequence_id long, offset long")
    tail = ["ids"] if with_ids else []
    return out.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *tail)
