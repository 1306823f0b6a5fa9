"""Anomaly labels, key resolution, and joins of texts and meanings to series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY


#: An interval is cut into buckets of the first width, in powers of this from the base, that leaves at most so many.
FAN, LEVELS = 64, 4


def _bucket(ts: Column, seconds: Column | int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def _cut(intervals: DataFrame, seconds: int) -> DataFrame:
    """Intervals by series, level and bucket. A long one is cut at a coarser level, so a far end costs a few rows."""
    span = (F.unix_timestamp("b") - F.unix_timestamp("a")) / seconds
    level = sum(((span >= FAN**k).cast("int") for k in range(1, LEVELS)), F.lit(0))
    width = F.lit(seconds) * F.pow(F.lit(FAN), level).cast("long")
    cover = F.explode(F.sequence(_bucket(F.col("a"), width), _bucket(F.col("b"), width)))
    return intervals.where("a <= b").select("series_key", "a", "b", level.alias("level"), cover.alias("bucket"))


def _dealt(points: DataFrame, cut: DataFrame, seconds: int) -> DataFrame:
    """Points once for each level that the intervals have (at most LEVELS), with their bucket there."""
    levels = sorted(r.level for r in cut.select("level").distinct().collect()) or [0]
    places = F.array(*[F.struct(F.lit(k).alias("level"), _bucket(F.col("ts"), seconds * FAN**k).alias("bucket")) for k in levels])
    return points.select(*points.columns, F.inline(places))


def label_points(points: DataFrame, intervals: DataFrame, keys: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Adds label: 1 if the point's ts lies in any interval [a, b] of its series, else 0.

    Intervals are cut into time buckets, so the join is an equality on series and bucket; points that several
    intervals cover stay single. A null key, ts or end never matches.
    """
    cut = _cut(intervals, bucket_seconds)
    dealt = _dealt(points, cut, bucket_seconds)
    hits = dealt.join(cut, ["series_key", "level", "bucket"]).where("ts between a and b").select(*keys).distinct().withColumn("_hit", F.lit(1))
    return points.join(hits, keys, "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def label_exact(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds label: 1 if (series_key, ts) is one of the marks."""
    known = marks.select("series_key", "ts").distinct().withColumn("_hit", F.lit(1))
    return points.join(known, ["series_key", "ts"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def resolve_key(series: DataFrame, table: DataFrame, candidates: list[Column]) -> DataFrame:
    """The entry of `table` (key, ...) for each series under the first candidate spelling that it has."""
    spelled = series.select("series_key", F.posexplode(F.array(*candidates)).alias("position", "key"))
    first = Window.partitionBy("series_key").orderBy("position")
    return spelled.join(table, "key").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def window_intervals(windows: DataFrame, intervals: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Per window and interval that covers points of it: a, b and the first and last covered place.

    Intervals are cut into time buckets as in label_points(), so points meet those of their bucket only.
    """
    cut = _cut(intervals, bucket_seconds)
    dealt = _dealt(windows.select(*KEY, "i", "ts"), cut, bucket_seconds)
    covered = dealt.join(cut, ["series_key", "level", "bucket"]).where("ts between a and b")
    return covered.groupBy(*KEY, "a", "b").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def window_flag(labelled: DataFrame, whole: bool = True) -> DataFrame:
    """1 if any point of the window is labelled; `whole=False` leaves out the last point, as older outputs did."""
    points = labelled if whole else labelled.where(F.col("i") < F.col("n") - 1)
    return points.groupBy(*KEY).agg(F.max("label").alias("flag"))


#: Parts to which questions of one series are dealt.
PARTS = 16


def fingerprint(series: Column, points: int = 10, digits: int = 4) -> Column:
    """64-bit key of an array's first values, rounded."""
    return F.xxhash64(F.transform(F.slice(series, 1, points), lambda x: F.round(x, digits)))


def _magnitude(series: Column, rtol: float, atol: float) -> Column:
    """A number of which equal series' differ by at most 1: the logarithm of the sum of sizes, in steps of twice the
    tolerance. If all values are within atol + rtol * abs(b), the sums A and B of sizes are within rtol * (B + c), with
    c = values * atol / rtol, so the logarithms of A + c and B + c are within little more than rtol."""
    values = F.flatten(series)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(F.coalesce(x, F.lit(0.0))))
    return F.floor(F.log(total + F.size(values) * (atol / rtol) + 1e-300) / (2.1 * rtol)).cast("long")


def match_captions(questions: DataFrame, captions: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per question the first caption (least caption_id) of the same series, all questions kept.

    questions: question_id, series [D][T]; captions: caption_id, series, text. Rows with identical series are one
    candidate with the first caption's text, so constant or repeated series cost one comparison. Candidates share number
    and length of variables, the fingerprint of the first one and, up to a neighbouring step, the magnitude of the whole
    series; all values are then compared within the tolerances.
    """

    def kinds(df: DataFrame) -> DataFrame:
        return df.withColumns({"_s": F.sha2(F.to_json("series"), 256), "_d": F.size("series"), "_t": F.size(F.col("series")[0])})

    asked = kinds(questions).withColumn("_part", F.pmod(F.xxhash64("question_id"), F.lit(PARTS)))
    keys = {"_f": fingerprint(F.col("series")[0]), "_m": _magnitude(F.col("series"), rtol, atol)}
    q = asked.groupBy("_s").agg(*[F.first(c).alias(c) for c in ("series", "_d", "_t")]).withColumns(keys)
    c = kinds(captions).where("_t > 0").groupBy("_s").agg(F.min(F.struct("caption_id", "text")).alias("best"), *[F.first(c).alias(c) for c in ("series", "_d", "_t")]).withColumns(keys)
    c = c.select("best", F.col("series").alias("other"), "_f", "_d", "_t", F.explode(F.array(*[F.col("_m") + k for k in (-1, 0, 1)])).alias("_m"))
    flat_a, flat_b = F.flatten("series"), F.flatten("other")
    same = F.forall(F.arrays_zip(flat_a.alias("a"), flat_b.alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= atol + rtol * F.abs(p["b"]))
    hits = q.join(c, ["_f", "_d", "_t", "_m"]).where(same)
    best = hits.groupBy("_s").agg(F.min("best").alias("m")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = asked.select("question_id", "_s", "_part").join(best.withColumn("_part", F.col("_part").cast("long")), ["_s", "_part"], "left")
    return found.select("question_id", F.col("m.caption_id").alias("caption_id"), F.col("m.text").alias("text"))


def match_report(matched: DataFrame) -> DataFrame:
    """total, matched and rate; an empty text counts as no match."""
    hit = F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0)
    return matched.agg(F.count("*").alias("total"), hit.alias("matched"), (hit / F.count("*")).alias("rate"))


def merge_segment_texts(segments: DataFrame, texts: DataFrame, default: str) -> DataFrame:
    """Segments (sample_id, segment_id, start, end, n) with external texts; missing ones get the default, ends are
    clamped to the sample and put in order."""
    joined = segments.join(texts.select("sample_id", "segment_id", "text").dropDuplicates(["sample_id", "segment_id"]), ["sample_id", "segment_id"], "left")
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("n") - 1)
    return joined.select("sample_id", "segment_id", F.least(clamp("start"), clamp("end")).alias("start"), F.greatest(clamp("start"), clamp("end")).alias("end"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit(default)).alias("text"))


def with_meaning(rows: DataFrame, meanings: DataFrame, column: str = "name") -> DataFrame:
    """Adds meaning: the table's entry for the name, else the name itself."""
    known = meanings.select(F.col("name").alias(column), "meaning")
    return rows.join(known, column, "left").withColumn("meaning", F.coalesce("meaning", column))


def caption_groups(captions: DataFrame, samples: DataFrame) -> DataFrame:
    """group_key, members (samples of the group) and captions: what a mask of positives needs. A caption's positives are
    the samples with its group key, so neither lists of members nor pairs are formed."""
    left = captions.groupBy("group_key").agg(F.count("*").alias("captions"))
    right = samples.groupBy("group_key").agg(F.count("*").alias("members"))
    return left.join(right, "group_key").select("group_key", "members", "captions")


def caption_members(captions: DataFrame, samples: DataFrame) -> DataFrame:
    """All captions (group_key, caption) and samples (group_key, sample_id) as members of their groups: group_key, side
    (caption or sample), id and positives, the number of members on the other side. A caption's positives are the
    samples with its group key; they are not expanded into pairs. A large group is dealt to PARTS tasks."""
    sides = captions.select("group_key", F.lit("caption").alias("side"), F.col("caption").alias("id")).unionByName(samples.select("group_key", F.lit("sample").alias("side"), F.col("sample_id").alias("id")))
    sizes = sides.groupBy("group_key").agg(F.count_if(F.col("side") == "sample").alias("caption"), F.count_if(F.col("side") == "caption").alias("sample"))
    dealt = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = sides.withColumn("_part", F.pmod(F.xxhash64("side", "id"), F.lit(PARTS))).join(dealt, ["group_key", "_part"])
    return met.select("group_key", "side", "id", F.when(F.col("side") == "caption", F.col("caption")).otherwise(F.col("sample")).alias("positives"))


def batch_positives(batches: DataFrame) -> DataFrame:
    """Within batches of bounded size (batch, sample_id, group_key): each sample's positives of its batch, as a list."""
    other = batches.groupBy("batch", "group_key").agg(F.array_sort(F.collect_list("sample_id")).alias("positives"))
    return batches.join(other, ["batch", "group_key"]).select("batch", "sample_id", "positives")
