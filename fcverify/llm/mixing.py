"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Every row has a hash; a source takes whole rounds of all its rows, and of one more round
the rows whose hash lies below its threshold. The threshold is found from sums of sizes by
source and hash bucket: the bucket that the budget ends in is cut into buckets again, and
only that one. Nothing is sorted by hash, and a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# Bits of the hash that one level of buckets looks at, and the number of levels.
LEVEL_BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix_hash() -> Column:
    """60 bits of the MD5 of id and text, so that rows without an id or with a shared one are told apart."""
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(known), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and the hash ``h`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"))
    return rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash().alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source.

    Sources by code point, null last, take the weights in turn and share the total by
    them; what exceeds ``most`` times a source is shared among the others by weight, until
    none exceeds it. That is one level for all: a source is capped if the share a weight gets,
    with all sources of a smaller ratio of cap to weight capped, reaches its ratio.
    The windows run over one row for each source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "position")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    source = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("position", F.row_number().over(by_name)).withColumn("weight", turn.cast("double"))
              .withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("capped", F.col("left") >= F.col("ratio") * F.col("weight_left")))
    # capped sources come first in the order by ratio, so the level is that of the first one that is not capped
    level = F.min_by(F.when(~F.col("capped"), F.col("left") / F.col("weight_left")),
                     F.when(~F.col("capped"), F.struct("ratio", "position"))).over(everything)
    return source.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``rounds``, how often all rows are taken, and ``below``: rows with a smaller hash are taken once more.

    Each level sums the sizes of one bucket of every source by the next bits of the hash:
    at most 2 ** LEVEL_BITS sums a source, combined before the shuffle.
    """
    share = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS)).cast("long")
    state = wanted.withColumn("rounds", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0).cast("long")))
    state = (state.withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size"))
             .withColumn("below", F.lit(0).cast("long")))
    for level in range(LEVELS):
        width = LEVEL_BITS * (LEVELS - 1 - level)
        bound = state.select(F.col("source").alias("s"), F.col("below").alias("low"), F.col("need").alias("open"))
        inside = F.shiftright(F.col("h"), width + LEVEL_BITS) == F.shiftright(F.col("low"), width + LEVEL_BITS)
        sums = (rows.join(bound, F.col("source").eqNullSafe(F.col("s")) & inside)
                .withColumn("bucket", F.shiftright("h", width)).groupBy("s", "low", "open", "bucket").agg(F.sum("size").alias("n")))
        run = Window.partitionBy("s").orderBy("bucket")
        filled = (sums.withColumn("upto", F.sum("n").over(run))
                  .withColumn("fits", F.col("upto") <= F.col("open")))
        cut = filled.groupBy("s").agg(
            F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.lit(0)).alias("got"),
            F.min(F.when(~F.col("fits"), F.col("bucket"))).alias("edge"),
            F.min_by(F.when(~F.col("fits"), F.col("n")), F.when(~F.col("fits"), F.col("bucket"))).alias("edge_size"),
            (F.max("bucket") + 1).alias("past"))
        start = F.shiftleft(F.coalesce("edge", "past"), width)
        if level == LEVELS - 1:  # the last bucket is one hash value: in or out, whichever is nearer
            nearer = F.col("edge").isNotNull() & (F.col("edge_size") <= 2 * (F.col("need") - F.col("got")))
            start = F.when(nearer, F.col("edge") + 1).otherwise(start)
        state = stored(state.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
                       .withColumn("below", F.coalesce(start, F.col("below")))
                       .withColumn("need", F.col("need") - F.coalesce("got", F.lit(0)))
                       .select("source", "source_size", "target", "rounds", "need", "below"), "thresholds")
    return state


def mix(rows: DataFrame) -> DataFrame:
    """The rows of ``sized`` with ``source_size``, ``target`` and ``taken``, the words that the mix takes of each.

    Rows of one id and text stand or fall together. A null source is a source. Without
    any word nothing is taken.
    """
    state = (thresholds(rows, stored(targets(rows), "targets"))
             .select(F.col("source").alias("s"), "source_size", "target", "rounds", "below"))
    times = F.col("rounds") + F.when((F.col("h") < F.col("below")) & (F.col("rounds") < MAX_REPEATS), 1).otherwise(0)
    return rows.join(state, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "h", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row."""
    ready(docs.sparkSession)
    return mix(stored(sized(docs), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns. Rows without words go."""
    ready(docs.sparkSession)
    rows = stored(sized(docs), "sizes")
    state = (thresholds(rows, stored(targets(rows), "targets"))
             .select(F.col("source").alias("of_source"), F.col("rounds").alias("of_rounds"), F.col("below").alias("of_below")))
    flat = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"))
    times = F.col("of_rounds") + F.when((mix_hash() < F.col("of_below")) & (F.col("of_rounds") < MAX_REPEATS), 1).otherwise(0)
    taken = (flat.withColumn("of_h", mix_hash()).join(state, F.col("source").eqNullSafe(F.col("of_source")))
             .withColumn("times", F.when(word_count(F.col("text")) > 0, times).otherwise(0)).filter("times > 0")
             .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
