"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
  ``most_epochs`` times the source's size and the excess is shared again by weight.  This is the level ``x`` with
  ``sum(min(cap, x * weight)) = all words``, found from running sums over the sources.
* Schedule: each source has as many turns as its target has blocks, the last one perhaps part of a block.  Slot ``i``
  takes the van der Corput point of ``i`` through the cumulative turns to a source; numbers whose point lies behind all
  turns are skipped, so each turn comes exactly once.  Any run of slots therefore holds every source in nearly its
  share.  Slots are ranked per source.
* Blocks: a source's documents, shuffled by a seeded hash, form a stream that repeats; it is cut into blocks of
  ``block`` words and at the target.  The slot of rank ``r`` takes block ``r``; slots and blocks are joined on (source, r).
  Every source ends at its target, to the nearest word, however small it is beside a block.

Sources and slots never meet in a cross join (points and intervals meet in grid cells), ranks and running sums are
two-level, and a source with a third of the rows is spread over blocks.  Only the table of sources, one row each,
is worked on in one task.

Edge cases: null text has size 0 and is never taken; a null source is a source; repeated rows are documents of
their own; with no words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, prefix_sums, read_table, stored

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 20240229
#: Slots a source has on average before blocks reach ``BLOCK_WORDS``; in a run of slots, a source's share is off by a few.
SLOTS_PER_SOURCE = 2048
BLOCK_WORDS = 4096
_BUCKET_BITS = 12
_CHUNK = 4096


def _source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, body_hash)."""
    text, source = column(docs, "text", "string"), column(docs, "source", "string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), source.alias("source"), _source_key(source).alias("key"), size.alias("size"), F.xxhash64(text).alias("body_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(key, source, source_size, weight, target), one row per source."""
    table = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", most_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "key")
    everything = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    table = table.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    # The first source in this order that its own level does not fill sets the level of all that follow.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return table.select("key", "source", "source_size", "weight", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def placed(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document with ``at``, the words before it in its source's shuffled stream."""
    rows = sizes.withColumn("h", F.xxhash64("doc_id", "key", "size", "body_hash", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - _BUCKET_BITS))
    before = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    bases = prefix_sums(rows, ["key"], "bucket", "size", "base")
    return inside.join(bases, ["key", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("h", "bucket", "base", "inside")


def block_words(total: int, sources: int, most: int = BLOCK_WORDS, slots: int = SLOTS_PER_SOURCE) -> int:
    return max(1, min(most, total // max(1, sources * slots)))


def schedule(shares: DataFrame, slots: float, sources: int) -> DataFrame:
    """(slot, key, r): which source each slot takes, and the slot's rank within the source.

    A source has its share of ``slots``, made whole upwards; slot numbers have gaps.
    """
    grid = max(1024, 4 * sources)
    order = Window.orderBy("key")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = shares.withColumn("turns", F.coalesce(F.ceil(F.col("target") * F.lit(float(slots)) / F.nullif(F.sum("target").over(everything), F.lit(0.0))), F.lit(0)))
    ends = turns.withColumn("top", F.sum("turns").over(order)).withColumn("all", F.sum("turns").over(everything)).withColumn("low", F.col("top") - F.col("turns"))
    total = ends.agg(F.coalesce(F.max("all"), F.lit(0))).first()[0]
    bits = max(1, (total - 1).bit_length())
    cell = lambda turn: F.floor(turn * grid / F.lit(max(1, total)))
    ends = ends.filter("turns > 0").select("key", "low", "top", F.explode(F.sequence(cell(F.col("low")), cell(F.col("top") - 1))).alias("cell"))
    turn = F.conv(F.rpad(F.reverse(F.bin("slot")), bits, "0"), 2, 10).cast("bigint")
    points = shares.sparkSession.range(0, 1 << bits).select(F.col("id").alias("slot"), turn.alias("turn")).filter(F.col("turn") < total).withColumn("cell", cell(F.col("turn")))
    hit = points.join(ends, "cell").filter("turn >= low and turn < top").select("slot", "key", F.floor(F.col("slot") / _CHUNK).alias("chunk"), F.lit(1).alias("one"))
    bases = prefix_sums(hit, ["key"], "chunk", "one", "base")
    rank = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    return hit.withColumn("inside", rank).join(bases, ["key", "chunk"]).select("slot", "key", (F.col("base") + F.col("inside")).alias("r"))


def pieces(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture: documents cut at block borders and at the target, with the slot that takes each piece (null: not taken).

    (doc_id, body_hash, key, size, source_size, target, at, slot, from_word, words); documents without words once,
    with a null slot.
    """
    sizes = stored(sized(docs), "mixing-sizes")
    shares = stored(targets(sizes, weights, most_epochs), "mixing-targets")
    total, sources = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    block = block_words(total, sources)
    plan = stored(schedule(shares, total / block, sources), "mixing-schedule")
    known = placed(sizes, seed).join(shares.select("key", "source_size", "target"), "key")
    epochs = known.filter("size > 0").withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most_epochs - 1)), lambda e: e * F.col("source_size") + F.col("at"))))
    cut = epochs.withColumn("r", F.explode(F.sequence(F.floor(F.col("p") / block), F.floor((F.col("p") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("p"), F.col("r") * block)
    high = F.least(F.col("p") + F.col("size"), (F.col("r") + 1) * block)
    goal = F.round("target").cast("bigint")
    parts = F.array(F.struct(F.lit(True).alias("wanted"), low.alias("low"), F.least(high, goal).alias("high")), F.struct(F.lit(False).alias("wanted"), F.greatest(low, goal).alias("low"), high.alias("high")))
    cut = cut.withColumn("part", F.explode(parts)).filter("part.low < part.high")
    cut = cut.withColumn("from_word", F.col("part.low") - F.col("p")).withColumn("words", F.col("part.high") - F.col("part.low"))
    columns = ["doc_id", "body_hash", "key", "size", "source_size", "target", "at", "slot", "from_word", "words"]
    taken = cut.join(plan, ["key", "r"], "left").withColumn("slot", F.when(F.col("part.wanted"), F.col("slot"))).select(*columns)
    none = known.filter("size = 0").select(*columns[:7], F.lit(None).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("from_word"), F.lit(0).cast("bigint").alias("words"))
    return taken.unionByName(none)


def taken_words(mixture: DataFrame) -> DataFrame:
    """(doc_id, body_hash, size, source_size, target, taken) per document; documents have unequal ``at`` if they have words."""
    words = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))
    with_words = mixture.filter("size > 0").groupBy("key", "at", "doc_id", "body_hash", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
    columns = ["doc_id", "body_hash", "size", "source_size", "target"]
    return with_words.select(*columns, "taken").unionByName(mixture.filter("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken")))


def first_words(text: Column, count: Column) -> Column:
    """A text up to the end of its ``count``-th word."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # a word and the space behind it; space before the first is one of its own
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), count.cast("int") + lead), ""), r"[\x20\x09-\x0D]+$", "")


def repeat_to_targets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in its columns.

    A source ends at its target: the document in which that lies is taken up to that word the last time, and ``n_chars``,
    where there is one, is that of the cut text.  Rows equal in id and text share what is taken of them evenly.
    """
    body = ["_id", "_none", "_body"]
    taken = taken_words(pieces(docs)).filter("size > 0").groupBy(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("body_hash").alias("_body")).agg(
        F.floor(F.sum("taken") / F.count(F.lit(1))).alias("_taken"), F.max("size").alias("_size"))
    whole, rest = F.floor(F.col("_taken") / F.col("_size")), F.col("_taken") % F.col("_size")
    copies = F.concat(F.array_repeat(F.col("_size"), whole.cast("int")), F.filter(F.array(rest), lambda x: x > 0))
    taken = taken.filter("_taken > 0").select(*body, "_size", copies.alias("_copies"))
    doc_id, text = column(docs, "doc_id", "bigint"), column(docs, "text", "string")
    rows = docs.withColumns({"_id": F.coalesce(doc_id, F.lit(0).cast("bigint")), "_none": doc_id.isNull(), "_body": F.xxhash64(text)})
    rows = rows.join(taken, body).withColumn("_words", F.explode("_copies"))
    made = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(first_words(F.col("text").cast("string"), F.col("_words")))
    rows = rows.withColumn("text", made.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("_words") == F.col("_size"), F.col("n_chars")).otherwise(F.length("text"))
        rows = rows.withColumn("n_chars", cut.cast(docs.schema["n_chars"].dataType))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(pieces(read_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
