"""Ranked lexical search by accumulator-limited evaluation, a term at a time.

Tasks turn chunks of documents into segments of an inverted index over the terms asked for (documents of a term and
how often each has it). A search then goes through an item's terms, rarest first, adding each term's part of the
score to its documents' accumulators. Once the greatest possible sum of the terms left is below the score that is
already k-th, a document without an accumulator cannot come in: no more are created, and the documents that have one
are scored to the end, exactly. The k-th score is that of the task so far, or of a first search over a part of the
segments if that is greater: a floor which the results are known to reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import chunks

#: Bytes of items' texts whose terms go to the tasks at once; more items are searched in further rounds.
ITEM_BYTES = 4 << 20
#: Documents whose accumulators are in memory at once, and documents of a segment at most.
ACCUMULATORS = 1 << 15
#: One in this many segments is searched first, for the floors.
SEED_PARTS = 16
#: Bytes of text, by byte: A-Z lower-cased, 0-9, a-z and all of other characters kept, the rest blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, in order, perhaps with empty strings between: maximal runs of ASCII letters and digits
    and of all characters outside ASCII, with A-Z lower-cased. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))], 0, texts.offset)
    return pc.ascii_split_whitespace(folded)


SEGMENT = "keys array<long>, sizes array<long>, terms array<int>, dfs array<int>, docs array<int>, tfs array<int>"


def _list(values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    for batch in (chunk.slice(at, most) for chunk in chunks(batches, 1) for at in range(0, chunk.num_rows, most)):
        lists = term_lists(batch.column(1))
        flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), np.diff(ends))
        full = np.asarray(pc.binary_length(flat)) > 0
        sizes = np.bincount(doc[full], minlength=len(lists))
        term = np.asarray(pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1), np.int64)
        known = term >= 0
        pair, tf = np.unique(term[known] * len(lists) + doc[known], return_counts=True)
        term, doc = np.divmod(pair, len(lists))
        terms, df = np.unique(term, return_counts=True)
        columns = [batch.column(0), sizes.astype(np.int64), terms.astype(np.int32), df.astype(np.int32), doc.astype(np.int32), tf.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([_list(c) for c in columns], ["keys", "sizes", "terms", "dfs", "docs", "tfs"])


class Segment:
    """Documents with their postings by term, scored term by term; made of one or more stored segments."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, documents: int, words: int) -> None:
        base = np.cumsum([0, *[len(r[0]) for r in rows]])
        self.keys = pa.concat_arrays([r[0] for r in rows])
        term = np.concatenate([np.repeat(r[2], r[3]) for r in rows])
        doc = np.concatenate([r[4] + b for r, b in zip(rows, base, strict=False)])
        tf = np.concatenate([r[5] for r in rows]).astype(np.int64)
        length = 100 - 50 + (50 * np.concatenate([r[1] for r in rows]) * documents) // max(words, 1)
        score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], score[order]
        self.terms, begin = np.unique(term[order], return_index=True)
        self.ends = np.append(begin, len(term))
        self.most = np.maximum.reduceat(self.score, begin) if len(begin) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best, their exact scores, and the number of accumulators created.

        terms: those of the item, rarest first. Documents that score below `floor` may be left out.
        """
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        left = np.cumsum(self.most[at][::-1])[::-1]
        total = np.zeros(len(self.keys), np.int64)
        alive = np.zeros(len(self.keys), bool)
        creating, kth = True, max(floor, 1)
        for t, bound in zip(at.tolist(), left.tolist(), strict=True):
            own, score = self.doc[self.ends[t] : self.ends[t + 1]], self.score[self.ends[t] : self.ends[t + 1]]
            if creating and bound < kth:
                creating = False
            if creating:
                total[own] += score
                alive[own] = True
                scores = total[alive]
                if len(scores) >= k:
                    kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            else:
                known = alive[own]
                total[own[known]] += score[known]
        found = np.flatnonzero(alive)
        scores = total[found]
        if len(scores) > k:  # the k-th score of all survivors; equal ones stay
            kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        keep = scores >= kth
        return found[keep], scores[keep], len(found)


def _np(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values)


def _best(keys: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k rows of greatest score, equal ones by ascending key, null keys last."""
    order = pc.sort_indices(pa.table({"s": scores, "k": keys}), sort_keys=[("s", "descending"), ("k", "ascending")], null_placement="at_end")[:k]
    return keys.take(order), scores[np.asarray(order)]


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, documents: int, words: int, k: int, floors: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Each item's best documents of this task: item (its number), i (its key), k, score."""
    floors = floors.copy()
    held: list[tuple[pa.Array, np.ndarray]] = [(pa.array([], pa.int64()), np.zeros(0, np.int64)) for _ in items]

    def take(rows: list[tuple]) -> None:
        segment = Segment(rows, weights, documents, words)
        for i, (_, terms) in enumerate(items):
            found, scores, _ = segment.search(terms, int(floors[i]), k)
            if len(found):
                keys, old = held[i]
                held[i] = _best(pa.concat_arrays([keys, segment.keys.take(pa.array(found))]), np.concatenate((old, scores)), k)
                if len(held[i][1]) == k:
                    floors[i] = max(floors[i], held[i][1][-1])

    rows, size = [], 0
    for b in batches:
        for i in range(b.num_rows):
            row = (b.column(0)[i].values, *[_np(b.column(c), i) for c in range(1, 6)])
            if rows and size + len(row[0]) > most:
                take(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[0])
    if rows:
        take(rows)
    for i, (keys, scores) in enumerate(held):
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int32)), pa.array([items[i][0]] * len(scores), pa.int64()), keys, pa.array(scores)], ["item", "i", "k", "score"])


def _item_blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their distinct terms, in blocks of about ITEM_BYTES of text; rows of one key are one item."""
    block: list[tuple[int | None, list[str]]] = []
    size = 0
    for row in items.select(items[item_key].cast("long").alias("i"), items[text].cast("string").alias("t")).orderBy("i").toLocalIterator():
        new = not block or block[-1][0] != row.i
        if new and size >= ITEM_BYTES:
            yield block
            block, size = [], 0
        terms = [t for t in dict.fromkeys(term_lists(pa.array([row.t], pa.string())).flatten().to_pylist()) if t]
        if new:
            block.append((row.i, terms))
        else:
            block[-1] = (row.i, list(dict.fromkeys(block[-1][1] + terms)))
        size += len(row.t or "") + 16
    if block:
        yield block


def _one_block(rows: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame | None:
    """The scored documents of one block's items, at least each item's k best."""
    words_of = sorted({t for _, terms in block for t in terms})
    if not words_of:
        return None
    vocabulary, most = pa.array(words_of, pa.string()), ACCUMULATORS
    segments = stored(rows.mapInArrow(lambda b: _segments(b, vocabulary, most), SEGMENT), "segments")
    one = segments.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    documents, words = int(one.n or 0), int(one.l or 0)
    held = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
    df = np.zeros(len(words_of), np.int64)
    for r in held.collect():  # at most a row for each term of the block
        df[r.terms] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    number = {t: i for i, t in enumerate(words_of)}
    terms = [np.array(sorted((number[t] for t in own), key=lambda i: (df[i], i)), np.int64) for _, own in block]
    asked = list(zip([i for i, _ in block], terms, strict=True))

    def search(part: DataFrame, floors: np.ndarray) -> DataFrame:
        return part.mapInArrow(lambda b: _search(b, asked, weights, documents, words, k, floors, most), "item int, i long, k long, score long")

    floors = np.zeros(len(block), np.int64)
    seed = search(segments.where(F.pmod(F.xxhash64("keys"), F.lit(SEED_PARTS)) == 0), floors)
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in seed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).collect():  # at most a row an item
        floors[r.item] = r.score
    return search(segments, floors).select("i", "k", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's k best documents: item key, rank from 1, key, score; highest score first, equal ones by ascending key
    (null keys last), scores above 0 alone.

    A document's score is the sum over the item's distinct terms of weight * ((10**9 * tf) div (1000 * tf + 20 * m))
    with weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 50 + (50 * n * N) div L: N documents with a term,
    L terms with repeats in all of them, n in this one, df documents with the term, tf times it is in the document.
    All documents count and are searched, whole texts; null and empty texts have no terms. Repeated rows and null keys
    of `docs` are documents of their own; rows of `items` with one key are one item, whose terms are those of all its
    rows; an item without terms, or empty tables, give no rows. Other columns are not read. Items may be many: they are
    searched in blocks of ITEM_BYTES, each with a pass over the documents.
    """
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    found = docs.sparkSession.createDataFrame([], "i long, k long, score long")
    for block in _item_blocks(items, item_key, item_text):
        part = _one_block(rows, block, k)
        found = found if part is None else found.unionByName(part)
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("k")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("i").alias(item_key), "rank", F.col("k").alias(key), "score")
