"""Mixing sources to target weights with DataFrame and SQL functions only.

Every source is one stream of words, its documents one after another, cut into blocks of a fixed number of words.
Targets become numbers of slots per source. Each slot draws an output shard, and the counts of a source by shard,
a multinomial draw of its total, are what is kept of that: they number the source's slots shard by shard. Slot
numbers run through a keyed permutation of the source's block numbers, again and again if there are more slots
than blocks, and are joined with the blocks by index. A shard holds its blocks in a pseudorandom order.

The totals are fixed before the draw: totals drawn as well would stray from the targets by a few per cent in small
sources, and take some documents more often than their limit allows. Nothing but a row for each source and shard
is ever brought together; a source that holds a third of all rows is spread over many chunks, shards and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACE, located, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; sources of fewer than 512 such blocks have shorter ones.
BLOCK_WORDS = 256
#: Slots of an output shard, on average; slots that one row stands for until they are drawn.
SHARD_SLOTS, RUN = 1 << 12, 1 << 12
#: Documents of a chunk, at least, on average; running sums are taken in chunks and over chunks.
CHUNK_DOCS = 2_000
#: Rounds of the permutation.
ROUNDS = 24


def permuted(k: Column, n: Column, *seed: Column) -> Column:
    """The image of k in a keyed permutation of 0 .. n-1, by swap-or-not rounds.

    A round pairs every x with (key - x) mod n and swaps the two, or not, by a hash of the larger: a bijection for
    any n, without numbers out of range.
    """

    def once(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, i), n) - x, n)
        return F.when(F.xxhash64(*seed, i, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), once)


def with_sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", row: Column | None = None) -> DataFrame:
    """row, id, source, size (number of words; null text: 0), print (of the text). `row` tells rows apart that are
    alike; without one given, it is a number that holds only once the result is stored."""
    row = F.monotonically_increasing_id() if row is None else row
    size = F.coalesce(F.regexp_count(docs[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row.alias("row"), docs[key].alias("id"), docs[source].cast("string").alias("source"), size.alias("size"), F.xxhash64(docs[text].cast("string")).alias("print"))


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target of every source.

    Sources in code-point order (null last) weigh `weights`, repeating, and share `share` times all words. A target
    stops at `most` times its source's size; the excess goes to the others by weight until none is above. That is
    min(level * weight, cap) for the one level at which the targets add up, found by running sums in the order of
    cap / weight. The windows run over one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    capped = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = capped.withColumn("level", left / F.sum("weight").over(here))
    # the level rises while one more source is at its cap and falls afterwards
    target = F.least(F.max("level").over(everything) * F.col("weight"), F.col("cap"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row a source: source, src (its number), source_size, target, length (words of a block), blocks, slots,
    shards (of the whole mix)."""
    length = F.greatest(F.least(F.floor(F.col("source_size") / 512), F.lit(block_words)), F.lit(1)).cast("long")
    plan = source_targets(sizes, share, weights).withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(F.lit(0.0)).cast("long")
    plan = plan.withColumn("slots", F.least(slots, 2 * F.col("blocks")))
    shards = F.greatest(F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots), F.lit(1)).cast("long")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    return plan.select("source", number.alias("src"), "source_size", "target", "length", "blocks", "slots", shards.alias("shards"))


def _tasks(spark: SparkSession) -> int:
    """Given to repartition() where few small rows stand for many: without a number they would end in one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_counts(plan: DataFrame, seed: int = 1) -> DataFrame:
    """The draw: src, shard, count, first (the source's slots in the shards before). Every slot of a source draws a
    shard on its own, so a source's counts are a multinomial sample of its slots; shards without any have no row."""
    runs = plan.where("slots > 0").select("src", "slots", "shards", F.explode(F.expr(f"sequence(0L, slots - 1, {RUN * RUN}L)")).alias("group"))
    runs = runs.withColumn("begin", F.explode(F.expr(f"sequence(group, least(group + {RUN * RUN}L, slots) - 1, {RUN}L)")))
    slots = runs.repartition(_tasks(plan.sparkSession), "src", "begin").select("src", "shards", F.explode(F.sequence("begin", F.least(F.col("begin") + RUN, "slots") - 1)).alias("slot"))
    drawn = slots.groupBy("src", F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "src", "slot"), "shards").alias("shard")).agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("src").orderBy("shard")) - F.col("count")
    return drawn.withColumn("first", before)


def shard_slots(counts: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """Every slot of the mix: shard, place (its order in the shard), src, slot, epoch, block."""
    dealt = counts.join(plan.select("src", "blocks"), "src").repartition(_tasks(plan.sparkSession), "src", "shard")
    slots = dealt.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("src"))
    return slots.select("shard", F.xxhash64(F.lit(seed), F.lit(-2), "src", "slot").alias("place"), "src", "slot", F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("epoch"), block.alias("block"))


def _placed(sizes: DataFrame) -> DataFrame:
    """With `begin`, the words of the same source before a document: sums in chunks of documents, then over chunks.

    The order is that of the chunk (by a hash), the key, the size and the text; rows alike in all are exchangeable.
    """
    rows = sizes.count()
    chunks = F.lit(max(1, round(rows / max(CHUNK_DOCS, rows**0.5))))
    dealt = sizes.withColumn("chunk", F.pmod(F.xxhash64("id", "print", F.lit(7)), chunks))
    same = Window.partitionBy("src", "chunk").orderBy("id", "size", "print", "row")
    inner = dealt.withColumn("inner", F.sum("size").over(same.rowsBetween(Window.unboundedPreceding, -1)))
    per = dealt.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    base = F.sum("words").over(Window.partitionBy("src").orderBy("chunk")) - F.col("words")
    joined = inner.join(per.select("src", "chunk", base.alias("base")), ["src", "chunk"])
    return joined.withColumn("begin", F.col("base") + F.coalesce("inner", F.lit(0))).drop("base", "inner", "chunk", "print")


def mix_spans(sizes: DataFrame, plan: DataFrame, seed: int = 1, how: str = "inner") -> DataFrame:
    """The mix: shard, place, slot, epoch, block, row, id, size, source_size, target, from_word, words.

    One row for each stretch of a document in a slot's block. With how="left", stretches that no slot takes are
    there as well, with null shard and slot.
    """
    known = plan.select(F.col("source").alias("s"), "src", "source_size", "target", "length")
    docs = _placed(sizes.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source"))
    first, last = F.floor(F.col("begin") / F.col("length")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("length"))
    parts = docs.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * F.col("length"), F.col("begin"))
    high = F.least((F.col("block") + 1) * F.col("length"), F.col("begin") + F.col("size"))
    parts = parts.select("src", "block", "row", "id", "size", "source_size", "target", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))
    # sizes behind an explode are not known to the planner: without the hint it would broadcast all slots
    return parts.join(shard_slots(shard_counts(plan, seed), plan, seed).hint("merge"), ["src", "block"], how)


def mixed_words(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row of `docs`: key, size, source_size, target (both of its source), taken (words in the mix, with repeats).

    A null or blank text has size 0 and is never taken; a null source is a source of its own; rows that repeat a
    key, or have none, are documents of their own and each has its row; an empty table gives no rows; other columns
    are not read. The same input gives the same mix in every run and partitioning.
    """
    sizes = stored(with_sizes(docs, text, key, source), "sizes")
    plan = stored(mix_plan(sizes, share, weights), "plan")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))).alias("taken")
    some = mix_spans(sizes, plan, seed, "left").groupBy("row", "id", "size", "source_size", "target").agg(taken).drop("row")
    none = sizes.where("size = 0").join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).withColumnRenamed("id", key)


def mixed_texts(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), seed: int = 1) -> DataFrame:
    """The mixed stream: rows with the columns of `docs`, one for each stretch of a document in a slot's block.

    A row's text is the words of its stretch, with the white space between them, and n_chars its length; its other
    columns are the document's. Rows are dealt by shard and lie in the order of the shard's slots. Documents of
    which nothing is taken have no row; repeated rows and null keys are documents of their own; further columns may
    have any names.
    """
    kept = located(docs)
    sizes = stored(with_sizes(kept, row=F.col(PLACE)), "sizes")
    spans = mix_spans(sizes, stored(mix_plan(sizes, share, weights), "plan"), seed)
    per = spans.groupBy(F.col("row").alias("__mix_of")).agg(F.collect_list(F.struct("shard", "place", "from_word", "words")).alias("__mix_spans"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = kept.join(per.hint("merge"), F.col(PLACE) == F.col("__mix_of"))
    # as a lambda's variable the words are found once a text, not once a span
    stretch = lambda w, s: F.ltrim(F.array_join(F.slice(w, s["from_word"].cast("int") + 1, s["words"].cast("int")), ""), F.lit(" \t\n\x0b\f\r"))
    of = lambda w: F.transform("__mix_spans", lambda s: F.struct(s["shard"].alias("shard"), s["place"].alias("place"), stretch(w, s).alias("text")))
    rows = cut.withColumn("__mix_part", F.explode(F.transform(F.array(words), of)[0])).drop("text", "__mix_spans", "__mix_of", PLACE)
    dealt = rows.repartition(_tasks(docs.sparkSession), F.col("__mix_part.shard")).sortWithinPartitions("__mix_part.shard", "__mix_part.place", "doc_id")
    text = F.col("__mix_part.text")
    return dealt.withColumn("text", text).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)
