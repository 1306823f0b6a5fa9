"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

A text's features are hashed counts of its letters' one- to four-byte sequences, damped and scaled to unit
length. Linear support vector machines (squared hinge) are fitted on a bounded sample of labelled documents: one
for each family against the others, and one for each pair of languages of a family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes

# Language families by ISO 639-1 code; a code that is absent is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
#: Buckets of the hashed features; texts of each language that are fitted on, at most.
BUCKETS, PER_LANGUAGE = 1 << 11, 1_000
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def family(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes), language)


def vector(text: str) -> np.ndarray:
    """Square roots of the counts of hashed letter sequences, scaled to unit length. Case, digits and signs don't count."""
    raw = np.frombuffer(b" " + _OTHER.sub(b" ", text.lower().encode()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    mixed = np.zeros(len(raw), np.uint32)
    for n in range(4):
        if len(raw) <= n:
            break
        mixed = (mixed[: len(raw) - n] ^ raw[n:]) * _MULTIPLIERS[n]
        mixed ^= mixed >> np.uint32(15)
        counts += np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    out = np.sqrt(counts)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights and bias (last) of a linear machine for y in {-1, 1}, by accelerated gradient on the squared hinge."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)  # both sides weigh the same
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (1 + 4 * cost))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - np.float32(2 * cost) * (x.T @ (share * slack * y)))
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


@dataclass
class Languages:
    """families: names; family_weights: a row each; members and machines: by family, pairs (i, j) vote for i if positive."""

    families: list[str]
    family_weights: np.ndarray
    members: list[list[str]]
    machines: list[list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts whose vectors are the rows of x."""
        x = np.hstack([x, np.ones((len(x), 1))])
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        shares = 1 / (1 + np.exp(-2 * np.clip(margins, -15, 15)))
        scores = shares[np.arange(len(x)), best] / np.maximum(shares.sum(axis=1), 1e-12)
        names = [""] * len(x)
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            votes = np.zeros((len(rows), len(own)))
            for i, j, w in self.machines[f]:
                p = 1 / (1 + np.exp(-2 * np.clip(x[rows] @ w, -15, 15)))
                votes[:, i] += p
                votes[:, j] += 1 - p
            first = votes.argmax(axis=1)
            if len(own) > 1:
                scores[rows] *= votes[np.arange(len(rows)), first] / (len(own) - 1)
            for row, k in zip(rows, first, strict=True):
                names[row] = own[k]
        return names, scores.round(6)  # the order of sums depends on the batch


def held_out(key: Column, fold: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by `fold`."""
    return F.crc32(key.cast("string").cast("binary")) % fold == 0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vector(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["lang", "x"])


def learning_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text: of each language its `per_language` distinct texts of the least hash, or all if it has fewer.

    Rows that repeat a text, under one key or many, count once. Tasks merge them before a shuffle, and hashes above a
    language's share go at once, so what is shuffled and ranked is about one and a half times the result.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # one row for each language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, min(1.0, 1.5 * per_language / r.n)).otherwise(share)
    # hashes run over all 64-bit numbers: the lowest share of them
    near = known.where((F.col("h") / 2.0**64 + 0.5) <= share).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_language).select("lang", "text")


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Languages | None:
    """Fits on lang and text of the rows that learning_rows() takes: at most `per_language` a language, a row of
    BUCKETS numbers each on the driver. None if there is nothing to learn from, as in an empty table."""
    rows = learning_rows(docs, per_language).mapInArrow(_vectors, "lang string, x binary").collect()
    by: dict[str, list[bytes]] = {}
    for r in rows:
        by.setdefault(r.lang, []).append(bytes(r.x))
    by = {k: sorted(v) for k, v in sorted(by.items())}
    if not by:
        return None
    x = np.stack([np.frombuffer(v, np.float32) for own in by.values() for v in own])
    y = np.repeat(np.arange(len(by)), [len(v) for v in by.values()])
    names = list(by)
    families = sorted({family(n) for n in names})
    of = np.array([families.index(family(n)) for n in names])[y]
    weights = np.stack([fit_machine(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else np.ones(BUCKETS + 1) for f in range(len(families))])
    members, machines = [], []
    for f in families:
        own = [i for i, n in enumerate(names) if family(n) == f]
        members.append([names[i] for i in own])
        machines.append([(a, b, fit_machine(x[np.isin(y, (own[a], own[b]))], np.where(y[np.isin(y, (own[a], own[b]))] == own[a], 1.0, -1.0))) for a, b in combinations(range(len(own)), 2)])
    return Languages(families, weights, members, machines)


def predict_languages(docs: DataFrame, model: Languages | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, lang_pred, score (0 to 1). `und` with score 0 if the text is null or has no letter, or nothing was learned.

    Rows that repeat a key, or have none, each have their row; equal texts have equal values; an empty table gives no
    rows; other columns are not read. One narrow stage, in parts of bounded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            texts = part.column(1).to_pylist()
            told = [i for i, t in enumerate(texts) if model and has_letter(t)]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if told:
                own, sure = model.predict(np.stack([vector(texts[i]) for i in told]))
                scores[told] = sure
                for i, name in zip(told, own, strict=True):
                    names[i] = name
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def language_id(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from documents that are not held out. Rows without a
    doc_id are neither learned from nor held out; the rest is as predict_languages() says."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    out = predict_languages(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
