"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition form one stream of ids in their order. A window may end where a document ends (no
penalty), where a sentence ends (small penalty) or at a place inside a sentence (larger penalty). With f(j) the
least cost of a stream cut at place j, f(j) = penalty(j) + min over i in [j - window, j) of f(i) + padding(j - i),
and padding(j - i) = window - (j - i): the minimum of f(i) + i over a sliding range, which a monotone queue keeps
in constant time a step.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import chunks, encoder, with_ends

SENTENCE_PENALTY, INNER_PENALTY = 1, 12
#: Distance of the places inside a sentence at which a window may end.
INNER_STEP = 16
#: sequence_id is the partition's number times this, plus the window's number there.
STRIDE = 1 << 36


def cut_places(docs: np.ndarray, sentences: np.ndarray, total: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stretch of a stream at which windows may end, ascending, and their penalties.

    docs, sentences: end places, counted from the stretch's begin, which is place `base` of the stream.
    """
    cost = np.full(total + 1, -1, np.int8)
    cost[INNER_STEP - base % INNER_STEP :: INNER_STEP] = INNER_PENALTY
    cost[sentences] = SENTENCE_PENALTY
    cost[docs] = 0
    cost[0] = -1
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


class Planner:
    """The dynamic programme over a stream that arrives in stretches.

    A cut is settled once every place from which the stream can still go on descends from it, so the cuts are the
    best ones of the whole stream, whatever the stretches. Only what follows the last settled cut is held.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.places, self.back = [0], [0]  # number 0: the last settled cut
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f(i) + i, place i, its number; least value in front

    def extend(self, places: np.ndarray, cost: np.ndarray) -> None:
        """Goes on with places, ascending and at most a window apart, and their penalties."""
        queue, back, window = self.queue, self.back, self.window
        k = len(self.places)
        for j, c in zip(places.tolist(), cost.tolist(), strict=True):
            while queue[0][1] < j - window:
                queue.popleft()
            value, _, i = queue[0]
            f = value + window + c  # f(j) + j
            back.append(i)
            while queue and queue[-1][0] >= f:
                queue.pop()
            queue.append((f, j, k))
            k += 1
        self.places.extend(places.tolist())

    def settle(self, last: bool) -> list[int]:
        """The newly settled cuts, ascending; all up to the end if this is the last stretch."""
        if last:
            common = len(self.places) - 1
        else:  # the nearest place that all live ones descend from
            live = [-k for _, _, k in self.queue]
            heapq.heapify(live)
            while True:
                common = -heapq.heappop(live)
                while live and live[0] == -common:
                    heapq.heappop(live)
                if not live:
                    break
                heapq.heappush(live, -self.back[common])
        cuts, k = [], common
        while k:
            cuts.append(self.places[k])
            k = self.back[k]
        self.places, self.back = self.places[common:], [max(0, b - common) for b in self.back[common:]]
        self.queue = deque((f, j, k - common) for f, j, k in self.queue)
        return cuts[::-1]


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """The window ends of least total padding and penalty, the last place among them."""
    planner = Planner(window)
    planner.extend(places, cost)
    return np.array(planner.settle(last=True), np.int64)


def sentence_end_ids(vocabulary: str) -> np.ndarray:
    """By id: whether the token ends a sentence or line."""
    vocab = encoder(vocabulary).tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.endswith((".", "!", "?", "Ċ", ".</w>", "!</w>", "?</w>"))
    return out


class _Stream:
    """The pieces of a partition's windows, from its documents in order."""

    def __init__(self, vocabulary: str, window: int, part: int) -> None:
        self.ends_sentence, self.planner, self.sequence = sentence_end_ids(vocabulary), Planner(window), part * STRIDE
        self.ids, self.first = np.zeros(0, "<u4"), 0  # ids that are not out yet, and the place of the first of them
        self.keys, self.ends, self.begin = pa.array([], pa.int64()), np.zeros(0, np.int64), 0  # of documents not wholly out

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        base = self.first + len(self.ids)
        sentences = np.flatnonzero(self.ends_sentence[ids]) + 1
        places, cost = cut_places(offsets[1:], sentences, len(ids), base)
        self.planner.extend(places + base, cost)
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, base + offsets[1:]))
        self.keys = pa.concat_arrays([self.keys, keys])

    def take(self, last: bool) -> pa.RecordBatch:
        """The pieces of the windows that are settled."""
        cuts = np.array(self.planner.settle(last), np.int64)
        done = int(cuts[-1]) if len(cuts) else self.first
        bounds = np.union1d(cuts, self.ends[self.ends <= done])
        lows = np.concatenate(([self.first], bounds[:-1])) if len(bounds) else bounds
        begins = np.concatenate(([self.begin], self.ends[:-1]))
        opens = np.concatenate(([self.first], cuts[:-1]))
        doc, win = np.searchsorted(self.ends, lows, side="right"), np.searchsorted(cuts, lows, side="right")
        raw = memoryview(np.ascontiguousarray(self.ids)).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (lows - self.first)).tolist(), (4 * (bounds - self.first)).tolist(), strict=True)]
        columns = [self.keys.take(pa.array(doc)), lows - begins[doc], bounds - lows, crc, (self.ends - begins)[doc], self.sequence + win, lows - opens[win]]
        self.sequence += len(cuts)
        gone = int(np.searchsorted(self.ends, done, side="right"))
        self.begin = int(self.ends[gone - 1]) if gone else self.begin
        self.ids, self.first, self.keys, self.ends = self.ids[done - self.first :], done, self.keys.slice(gone), self.ends[gone:]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


NAMES = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of the documents' ids (each document's followed by `end_id`) in windows of at most `window` ids.

    Per piece: key, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (place in the window). Every id lies in exactly one piece, windows hold consecutive pieces in input order,
    and within a partition only the last window is cut short by the end of the input. Partitions of the input
    are packed apart, each by the best cuts of its whole stream, so nothing is shuffled; memory is that of a chunk of
    texts and of the windows not settled yet. A null text is empty and has the end id alone; repeated rows and null
    keys are packed as further documents; an empty table gives no rows; other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        stream = _Stream(vocabulary, window, TaskContext.get().partitionId())
        for batch in chunks(batches, 1):
            ids, offsets = with_ends(*enc.encode(batch.column(1)), end_id)
            stream.add(batch.column(0), ids, offsets)
            yield stream.take(last=False)
        yield stream.take(last=True)

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    out = rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in NAMES))
    return out.withColumnRenamed("k", key)
