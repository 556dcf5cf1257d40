"""Mixing sources to target weights, with DataFrame functions only.

Texts are packed into blocks of ``block_words`` words (fewer in a source of less than
64 blocks) along each source: documents
stand one after the other in a pseudorandom order and a block may span several.
The mix is a sequence of slots of one block each, dealt over output shards. Each
slot draws its source by the targets' shares, so the source counts of a shard are
multinomial; slots that a source drew beyond its target go to the sources that drew
less, so the totals meet the targets. The n-th slot of a source takes block
permutation(n mod blocks) of it, so a block comes no more than once in a pass over its
source. Slots and blocks meet in a join by (source, block).

Permutations are swap-or-not shuffles keyed by XXH64: bijections on exactly as many
numbers as there are, computed by each row for itself. Offsets of documents in their
source are two-level prefix sums over hashed buckets, so no source is ever in one
task.

Results for odd input: null, empty and blank texts have size 0 and no block; a null
source is a source of its own, last in order; repeated rows are rows of their own; a
source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

WEIGHTS = (3, 1, 2)
#: Words in a block, slots in an output shard, rounds of the permutations, buckets of the prefix sums in each source.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, BUCKETS = 64, 4_096, 12, 1_024
#: Blocks that a source is cut into at least, if it has the words.
FEWEST = 64
#: Rows, besides one for each source, of the table that finds a number's source.
LOOKUPS = 1_024


def n_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has 0."""
    # a word begins wherever a byte that is no blank follows a blank or the beginning
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    inner = F.btrim(flat, F.lit(" "))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """``x`` (0 <= x < n) under a pseudorandom permutation of 0..n-1 that ``key`` chooses (swap-or-not)."""

    def step(at: Column, r: Column) -> Column:
        shift = F.pmod(F.xxhash64(F.lit("shift"), r, *key), n)
        other = F.pmod(shift - at, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(at, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size; a row for each source) with ``target``: words that the mix takes of it.

    Sources by code point, null last, have ``weights`` in turn. They share ``share``
    of all words by weight, none above ``most`` of its own: the sources that reach
    that bound are those with the least size for their weight, so they are the first
    rows in that order up to the last one that the rest's even level would fill.
    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    turn = F.array(*(F.lit(float(w)) for w in weights))
    d = sizes.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # what a unit of weight gets if all sources before this one are full
    d = d.withColumn("level", left / rest).withColumn("full", F.col("weight") * F.col("level") > F.col("cap"))
    # fullness holds for a first part of the order; the level of the first row that isn't full is everyone's
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(every)["level"]
    return d.select("source", "source_size", F.when(F.col("full") | level.isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * level, F.col("cap"))).alias("target"))


def identity(key: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes (k1, k2) that rows share only if they repeat key, source and text."""
    return F.xxhash64(key, source, text).alias("k1"), F.xxhash64(text, source, key).alias("k2")


class Mix:
    """The frames of a mix: ``sources``, ``docs`` (with their place in the source), ``pieces`` and ``slots``."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0):
        self.block_words, b = block_words, F.lit(block_words)
        sized = checkpoint(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *identity(F.col(key), F.col(source), F.col(text))))
        spot = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(BUCKETS)).cast("int"))
        parts = spot.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = targets(sizes, weights, share, most)
        # blocks that a source has and that the mix takes: as many passes, and parts of one, as the target has. A last block may be
        # short, and small sources have shorter blocks, so that they too can meet their target
        plan = plan.withColumn("length", F.greatest(F.lit(1), F.least(b, F.ceil(F.col("source_size") / FEWEST))))
        plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
        takes = F.greatest(F.lit(1), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
        plan = plan.withColumn("takes", F.when(F.col("target") > 0, F.least(takes, F.floor(F.lit(most) * F.col("blocks")))).otherwise(F.lit(0).cast("long")))
        order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
        plan = plan.withColumn("first", F.coalesce(F.sum("takes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        self.sources = checkpoint(plan.withColumn("no", F.row_number().over(order)))
        within = Window.partitionBy("source", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
        named = self.sources.select("source", "no", "source_size", "target", "length")
        placed = spot.join(parts.select("source", "bucket", "ahead").withColumnsRenamed({"source": "s", "bucket": "k"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
        placed = placed.select("doc_id", "source", "k1", "k2", "size", (F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start"))
        self.docs = checkpoint(placed.join(named.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("row", F.monotonically_increasing_id()))
        # a piece: the part of a document that is in one block, words [lo, hi) of the document
        b = F.col("length")
        span = self.docs.where("size > 0").select("row", "doc_id", "k1", "k2", "no", "size", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        lo = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        hi = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        self.pieces = span.select("row", "doc_id", "k1", "k2", "no", "block", lo.alias("lo"), hi.alias("hi"))
        self.slots = self._slots(docs.sparkSession, shard_slots, seed)

    def _slots(self, spark, shard_slots: int, seed: int) -> DataFrame:
        """(shard, slot, no, turn, block): a row for each slot of the mix.

        Each slot draws its source by the targets' shares, so the counts of a shard are
        multinomial. A source's slots beyond its target, taken at even steps, go to the
        sources that drew less than theirs; these are of the order of the root of all slots.
        """
        total = self.sources.agg(F.sum("takes")).first()[0] or 0
        owner = self.sources.where("takes > 0").select("no", "first", "takes", "blocks")
        slot = spark.range(0, total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"))
        slot = slot.withColumn("at", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "slot"), F.lit(max(total, 1))))
        drawn = self._owned(slot, owner.select("no", "first", F.col("takes").alias("many")), total)
        counts = checkpoint(drawn.groupBy("no", "shard").agg(F.count("*").alias("slots")))
        before = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        ahead = counts.select("no", "shard", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("ahead"))
        within = Window.partitionBy("no", "shard").orderBy("slot")
        drawn = drawn.join(ahead, ["no", "shard"]).select("shard", "slot", "no", (F.col("ahead") + F.row_number().over(within) - 1).alias("n"))
        got = owner.join(counts.groupBy("no").agg(F.sum("slots").alias("got")), "no", "left").select("no", "takes", F.coalesce("got", F.lit(0)).alias("got"))
        order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
        spare = F.greatest(F.col("got") - F.col("takes"), F.lit(0))
        lack = F.greatest(F.col("takes") - F.col("got"), F.lit(0))
        plan = checkpoint(got.select("no", "takes", "got", lack.alias("many"), F.coalesce(F.sum(spare).over(order), F.lit(0)).alias("spare"), F.coalesce(F.sum(lack).over(order), F.lit(0)).alias("first")))
        moved = plan.agg(F.sum("many")).first()[0] or 0
        # what a source has too many is taken at even steps, so that no shard loses more of it than others
        many = F.greatest(F.col("got") - F.col("takes"), F.lit(0))
        placed = drawn.join(plan.select("no", many.alias("many"), "spare", F.expr("got div greatest(got - takes, 1)").alias("step")), "no")
        gone = F.least("many", F.expr("n div step"))
        is_over = (F.col("n") % F.col("step") == F.col("step") - 1) & (F.expr("n div step") < F.col("many"))
        kept = placed.where(~is_over).select("shard", "slot", "no", (F.col("n") - gone).alias("n"))
        over = placed.where(is_over).select("shard", "slot", (F.col("spare") + F.expr("n div step")).alias("at"))
        given = self._owned(over, plan.where("many > 0").select("no", "first", "many", "got"), moved).select("shard", "slot", "no", (F.col("got") + F.col("at") - F.col("first")).alias("n"))
        n, blocks = F.col("n"), F.col("blocks")
        turn = F.floor(n / blocks)
        block = permuted(F.pmod(n, blocks), blocks, F.lit(seed), F.col("no"), turn)
        return kept.union(given).join(owner.select("no", "blocks"), "no").select("shard", "slot", "no", turn.alias("turn"), block.alias("block"))

    @staticmethod
    def _owned(numbers: DataFrame, ranges: DataFrame, total: int) -> DataFrame:
        """``numbers`` (at, ...) with the row of ``ranges`` (no, first, many) that each is in: ranges are cut at multiples of a width, of which there are LOOKUPS at most."""
        width = F.lit(-(-max(total, 1) // LOOKUPS))
        cut = ranges.withColumn("cut", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("many") - 1) / width))))
        found = numbers.withColumn("cut", F.floor(F.col("at") / width)).join(cut, "cut")
        return found.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("many"))).drop("cut")

    def shards(self) -> DataFrame:
        """(shard, no, slots): the draw, counted."""
        return self.slots.groupBy("shard", "no").agg(F.count("*").alias("slots"))

    def taken(self) -> DataFrame:
        """The rows of ``docs`` with ``taken``: words of the document that the mix takes, repeats counted."""
        times = self.slots.groupBy("no", "block").agg(F.count("*").alias("times"))
        words = self.pieces.join(times, ["no", "block"]).groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        return self.docs.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for each document and pass over its source, the blocks taken.

    A document that a pass takes whole comes with its text; of one that is taken in
    part come the words of the blocks taken, in order. White space before the first
    and after the last word goes.
    """
    mix = Mix(docs, key, text, source, **options)
    spans = mix.pieces.join(mix.slots.select("no", "block", "turn"), ["no", "block"]).groupBy("k1", "k2", "row", "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    # rows that repeat are one row of texts and several of the mix; each text is joined once
    k1, k2 = identity(F.col(key), F.col(source), F.col(text))
    texts = docs.select(F.struct("*").alias("body"), k1, k2)
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("n = 1").drop("n")
    taken = texts.join(spans.groupBy("k1", "k2").agg(F.collect_list("spans").alias("copies")), ["k1", "k2"])
    words = F.regexp_extract_all(F.col("body").getField(text), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    taken = taken.withColumn("words", words).select("body", F.explode(F.transform("copies", lambda spans: F.transform(spans, lambda s: F.array_join(F.slice("words", (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")), "")))).alias("parts"))
    whole = F.btrim(F.array_join("parts", ""), F.lit(" \t\n\x0b\x0c\r"))
    return taken.select(*((whole if c == text else F.col("body").getField(c)).alias(c) for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")
