"""Toxicity by a classifier chain: linear models in sequence, later ones fed with earlier probabilities.

The categories are label columns, in order. Features are the distinct words of a text, the first three to six
letters of each (stems that inflected forms share) and a few marks of style. The chain is fitted on a bounded
sample of labelled rows, near copies counted once: features that hold a category's label with confidence are its
vocabulary, and a logistic model weighs them. While it is trained, a later model sees out-of-fold probabilities
of the earlier ones: both the vocabulary and the weights behind them come from the other folds alone, so they are
as uncertain as those it will meet on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored

#: Labelled rows that the chain is fitted on, at most; features of a category, at most; folds of the out-of-fold pass.
SAMPLE_ROWS, FEATURES, FOLDS = 20_000, 4_000, 5
#: A feature joins a vocabulary if the lower confidence bound of its label's share is this many times the label's
#: share of all rows, but at most this share itself; features of fewer rows than the last number stay out.
LIFT, SURE, DEVIATIONS, LEAST_ROWS = 3.0, 0.4, 1.3, 3
#: Lengths of the stems. A stem ends in a mark, so that it differs from the word of the same letters.
STEMS = range(3, 7)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text, lower-cased runs of letters, in order; null texts have none."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}]+")


def word_features(words: pa.Array) -> list[pa.Array]:
    """The word itself and its stems; null where a word is too short for one."""
    length = pc.utf8_length(words)
    return [words, *(pc.if_else(pc.greater_equal(length, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", ""), None) for n in STEMS)]


def _ascii_capitals(texts: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8)
    ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(texts), np.int64))))
    return np.diff(np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))[ends])


class Features:
    """Of a batch of texts: how many different words each has, and pairs (row, word) without repeats."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.rows = n = len(texts)
        lists = word_lists(texts)
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        sizes = np.asarray(pc.list_value_length(lists), np.int64)
        row, code = np.repeat(np.arange(n), sizes), np.asarray(coded.indices, np.int64)
        real = np.asarray(pc.binary_length(self.words), np.int64)[code] > 0 if len(code) else np.zeros(0, bool)
        row, code = row[real], code[real]
        count = np.bincount(row, minlength=n)
        letters = np.bincount(row, np.asarray(pc.utf8_length(self.words), np.int64)[code] if len(code) else None, n).astype(np.int64)
        pairs = np.unique(row * max(len(self.words), 1) + code)
        self.row, self.code = np.divmod(pairs, max(len(self.words), 1))
        self.distinct = np.bincount(self.row, minlength=n)
        # how a text is written: shares of repeated words, capitals and signs, in tenths
        some, size = np.maximum(count, 1), np.maximum(np.asarray(pc.utf8_length(texts), np.int64), 1)
        signs = np.maximum(size - letters - some, 0)
        self.style = [[f"#repeats{a}", f"#capitals{b}", f"#signs{c}"] for a, b, c in zip((10 * (some - self.distinct) // some).tolist(), (10 * _ascii_capitals(texts) // size).tolist(), np.minimum(9, 20 * signs // size).tolist(), strict=True)]

    def among(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, number of a feature in `names`) without repeats, in order."""
        of = np.stack([np.asarray(pc.fill_null(pc.index_in(f, value_set=names, skip_nulls=True), -1), np.int64) for f in word_features(self.words)], axis=1)
        hit = (of >= 0).any(axis=1)[self.code] if len(self.code) else np.zeros(0, bool)
        row, number = np.repeat(self.row[hit], of.shape[1]), of[self.code[hit]].ravel()
        styles = np.asarray(pc.fill_null(pc.index_in(pa.array([x for own in self.style for x in own], pa.string()), value_set=names), -1), np.int64)
        row, number = np.concatenate((row, np.repeat(np.arange(self.rows), 3))), np.concatenate((number, styles))
        pairs = np.unique(row[number >= 0] * max(len(names), 1) + number[number >= 0])
        return np.divmod(pairs, max(len(names), 1))

    def names(self) -> pa.Array:
        """All features of the batch."""
        style = pa.array(sorted({x for own in self.style for x in own}), pa.string())
        return pc.drop_null(pc.unique(pa.concat_arrays([*word_features(self.words), style])))


def _alike(words: list[str]) -> int:
    """The least hash of three successive words, which near copies mostly share."""
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 0):
        likes = [_alike([w for w in own if w]) for own in word_lists(batch.column(0)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(likes, pa.int64())], ["id", "labels", "text", "alike"])


def feature_counts(sample: DataFrame, categories: int) -> DataFrame:
    """f, n0 .. and p0_0 ..: in how many rows of each fold a feature is, and in how many with each category's label."""
    columns = [f"n{k}" for k in range(FOLDS)] + [f"p{i}_{k}" for i in range(categories) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            own, names = Features(batch.column(0)), None
            names = own.names()
            row, number = own.among(names)
            fold = np.asarray(batch.column(1), np.int64)[row]
            labels = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, categories)[row]
            per = [np.bincount(number[fold == k], minlength=len(names)) for k in range(FOLDS)]
            per += [np.bincount(number[(fold == k) & (labels[:, i] > 0)], minlength=len(names)) for i in range(categories) for k in range(FOLDS)]
            yield pa.RecordBatch.from_arrays([names, *[pa.array(c.astype(np.int64)) for c in per]], ["f", *columns])

    part = sample.select("text", "fold", "labels").mapInArrow(run, "f string, " + ", ".join(f"{c} long" for c in columns))
    every = sum((F.col(f"n{k}") for k in range(1, FOLDS)), F.col("n0"))
    return stored(part.groupBy("f").agg(*[F.sum(c).alias(c) for c in columns]).where(every >= LEAST_ROWS), "features")


def vocabulary(counts: DataFrame, totals: dict[str, int], category: int, without: int | None, most: int = FEATURES) -> list[str]:
    """The features that go with a category's label in all folds but `without`. `most` bounds what is collected."""
    folds = [k for k in range(FOLDS) if k != without]
    n, p = (sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")) for c in ("n", f"p{category}_"))
    base = sum(totals[f"p{category}_{k}"] for k in folds) / max(sum(totals[f"n{k}"] for k in folds), 1)
    if not base:
        return []
    z, share = DEVIATIONS, F.col("p") / F.col("n")
    bound = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    chosen = counts.select("f", n.alias("n"), p.alias("p")).where(F.col("n") >= LEAST_ROWS).withColumn("bound", bound).where(F.col("bound") >= min(LIFT * base, SURE))
    return sorted(r.f for r in chosen.orderBy(F.desc(F.col("bound") * F.sqrt("n")), "f").limit(most).collect())


class Sparse:
    """Rows of 0/1 features by their places, beside a few dense columns and the intercept's."""

    def __init__(self, places: list[list[int]], width: int, dense: np.ndarray) -> None:
        self.row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        self.place = np.array([x for p in places for x in p], np.int64)
        self.width, self.dense = width, np.hstack([dense, np.ones((len(places), 1))])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.place], len(self.dense)) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.place, r[self.row], self.width), self.dense.T @ r))


def fit_logistic(x: Sparse, y: np.ndarray, use: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights and intercept (last) of a ridge logistic model of the rows in `use`, by accelerated gradient steps."""
    v = np.ones(x.width + x.dense.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.back(x.dot(v / np.linalg.norm(v)) * use)
    step = 1 / (0.3 * np.linalg.norm(v) + ridge)
    w = v = np.zeros(x.width + x.dense.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(v), -30, 30)))
        new = v - step * (x.back((p - y) * use) + ridge * np.append(v[:-1], 0))
        w, v = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Chain:
    """By category: the weights of its features, of the text's length and of the categories before, the intercept."""

    categories: list[str]
    weights: list[dict[str, float]]
    lengths: list[float]
    links: list[list[float]]
    intercepts: list[float]

    def probabilities(self, sums: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A column for each category, in order, from the sums of feature weights; each sees those before it."""
        out = np.zeros(sums.shape)
        for i, (per_length, link, intercept) in enumerate(zip(self.lengths, self.links, self.intercepts, strict=True)):
            margin = sums[:, i] + per_length * length + out[:, :i] @ np.array(link) + intercept
            out[:, i] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return out


def _dense(distinct: np.ndarray) -> np.ndarray:
    """How long a text is, for the models: long texts meet more features by chance."""
    return np.log1p(distinct) / 5


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = SAMPLE_ROWS, most_features: int = FEATURES) -> Chain:
    """Fits the chain on documents (doc_id, text) and labels (doc_id, a 0/1 column for each category).

    Takes at most `most_rows` labelled rows, those of the least hash of the id; rows with a null label or without
    a document are left out, rows that repeat an id count once, a null text is empty. No labelled rows give a
    chain that says no to everything. Other columns of either table are not read.
    """
    known = labels.dropna(subset=["doc_id", *categories]).dropDuplicates(["doc_id"])
    ids = known.select(F.col("doc_id").alias("id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"))
    bounded = ids.orderBy(F.xxhash64("id"), "id").limit(most_rows)  # the bound makes it fit to broadcast
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text")).join(F.broadcast(bounded), "id").select("text", "id", "labels")
    every = stored(rows.mapInArrow(_prepared, "id long, labels array<int>, text string, alike long"), "sample")
    once = every.join(every.groupBy("alike").agg(F.min("id").alias("id")), ["alike", "id"], "left_semi").dropDuplicates(["id"])
    sample = stored(once.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int")), "sample")
    counts = feature_counts(sample, len(categories))
    one = lambda k: F.when(F.col("fold") == k, 1).otherwise(0)
    sums = {f"n{k}": one(k) for k in range(FOLDS)} | {f"p{i}_{k}": one(k) * F.col("labels")[i] for i in range(len(categories)) for k in range(FOLDS)}
    totals = {c: v or 0 for c, v in sample.agg(*[F.sum(e).alias(c) for c, e in sums.items()]).first().asDict().items()}
    # the last category's probabilities feed no other model
    vocab = {(i, k): vocabulary(counts, totals, i, k, most_features) for i in range(len(categories)) for k in (None, *(range(FOLDS) if i + 1 < len(categories) else ()))}
    wanted = pa.array(sorted(set().union(*vocab.values())), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            own = Features(batch.column(0))
            row, number = own.among(wanted)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=own.rows)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), lists, pa.array(_dense(own.distinct))], ["id", "labels", "fold", "own", "dense"])

    got = sample.select("text", "id", "labels", "fold").mapInArrow(run, "id long, labels array<int>, fold int, own array<int>, dense double").collect()
    if not got:
        return Chain(categories, [{} for _ in categories], [0.0] * len(categories), [[0.0] * i for i in range(len(categories))], [-30.0] * len(categories))
    got.sort(key=lambda r: r.id)
    labels_of = np.array([r.labels for r in got], float)
    fold = np.array([r.fold for r in got])
    dense = np.array([[r.dense] for r in got])
    names = wanted.to_pylist()
    number = {f: k for k, f in enumerate(names)}

    def design(words: list[str]) -> Sparse:
        place = np.full(len(names), -1)
        place[[number[w] for w in words]] = np.arange(len(words))
        return Sparse([[x for x in place[np.array(r.own, int)].tolist() if x >= 0] for r in got], len(words), dense)

    chain = Chain(categories, [], [], [], [])
    for i in range(len(categories)):
        words, y = vocab[i, None], labels_of[:, i]
        w = fit_logistic(design(words), y, np.ones(len(got)))
        chain.weights.append(dict(zip(words, w.tolist(), strict=False)))
        chain.lengths.append(float(w[len(words)]))
        chain.links.append([float(v) for v in w[len(words) + 1 : -1]])
        chain.intercepts.append(float(w[-1]))
        if i + 1 == len(categories):
            break
        held = np.zeros(len(got))
        for k in range(FOLDS):
            x = design(vocab[i, k])
            held[fold == k] = x.dot(fit_logistic(x, y, (fold != k).astype(float), rounds=100))[fold == k]
        dense = np.hstack([dense, 1 / (1 + np.exp(-np.clip(held, -30, 30)))[:, None]])
    return chain


class _Scorer:
    """Probabilities of a batch of texts under a chain."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        names = sorted(set().union(*chain.weights))
        self.names = pa.array(names, pa.string())
        self.weights = np.array([[own.get(f, 0.0) for own in chain.weights] for f in names]).reshape(len(names), len(chain.weights))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        own = Features(texts)
        row, number = own.among(self.names)
        sums = np.stack([np.bincount(row, self.weights[number, i], own.rows) for i in range(self.weights.shape[1])], axis=1)
        return self.chain.probabilities(sums, _dense(own.distinct))


def predict(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: key and p_<category> of every category.

    A null text counts as empty; repeated rows and null keys stay; an empty table gives no rows; other columns are
    not read.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(chain)
        for batch in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, score(batch.column(1)).T)], ["k", *names])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, " + ", ".join(f"`{n}` double" for n in names)).withColumnRenamed("k", key)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose last category's probability is below
    the threshold; rows with a null text count as empty, repeated rows stay."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(chain)
        for batch in by_bytes(batches, place):
            yield batch.filter(pa.array(score(batch.column(place))[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain low_quality -> toxic, the two properties that the labels table knows, fitted on labelled documents."""
    return fit_chain(docs, labels.withColumn("low_quality", 1 - F.col("quality")), ["low_quality", "toxic"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic at or above the threshold), kept."""
    scored = predict(docs, toxicity_chain(docs, labels))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold).withColumn("kept", ~F.col("toxic"))
