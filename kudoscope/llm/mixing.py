"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points walk through the cumulative shares of the sources, so every
stretch of the schedule holds each source close to its share. The n-th slot of a
source takes the n-th block of that source: its documents in shuffled order, laid
end to end up to three times and cut into blocks of equal size in words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kudoscope.llm import common
from kudoscope.session import materialise

BLOCK_WORDS = 1024
MAX_PASSES = 3
SEED = 17
GOLDEN = (5 ** 0.5 - 1) / 2
_SLOT_RUN, _SLOT_BLOCK = 12, 24  # bits of a slot number that make up a run and a block of runs


class Mix(NamedTuple):
    documents: DataFrame  # doc_id, source, size, source_size, target, taken
    pieces: DataFrame     # slot, source_index, block, doc_id, pass, from_word, to_word
    sources: DataFrame    # source, source_index, weight, source_size, target, quota


def cyclic_weights(index: Column) -> Column:
    """Weights 1, 2, 3, repeating."""
    return F.pmod(index, F.lit(3)) + 1


def source_targets(rows: DataFrame, weights=cyclic_weights, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source with its weight and target.

    Targets share all words by weight; none exceeds ``max_passes`` times its source,
    and what is cut is dealt again by weight. That is one water level: a source gets
    the smaller of ``level x weight`` and its limit, and the level rises until all
    words are dealt. Only sums of this table reach the driver. The table has one
    narrow row per source and is ordered in one task, whatever its sources hold.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("source_index", F.row_number().over(by_source) - 1)
               .withColumn("weight", weights(F.col("source_index")).cast("double"))
               .withColumn("limit", F.col("source_size") * max_passes))
    sources = materialise(sources, "mix-sources")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (weight or 1), -1.0
    while level > before:
        full = F.col("limit") < F.lit(level) * F.col("weight")
        given, open_weight = sources.agg(F.sum(F.when(full, F.col("limit"))),
                                         F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (total - (given or 0)) / open_weight if open_weight else level
    return (sources.withColumn("target", F.least(F.lit(before) * F.col("weight"),
                                                 F.col("limit").cast("double")))
            .withColumn("quota", F.least(F.round("target").cast("long"), F.col("limit")))
            .drop("limit"))


def schedule(spark: SparkSession, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``slot, source_index, block``: which source fills each slot, and with which block.

    Slot i stands at the point frac(i x golden ratio). The unit interval is cut into
    cells, so finding the source of a point is an equality join with the few
    intervals of its cell. Slots beyond a source's quota fall away; the few that the
    points still owe a source follow at the end.
    """
    upto = Window.orderBy("source_index").rowsBetween(Window.unboundedPreceding, 0)
    total, n_sources = sources.agg(F.sum("quota"), F.count(F.lit(1))).first()
    n_slots = -(-(total or 0) // block_words)
    cells = max(4 * n_sources, 1)
    spans = (sources.filter("quota > 0")
             .withColumn("hi", F.sum("quota").over(upto) / F.lit(float(total or 1)))
             .withColumn("lo", F.col("hi") - F.col("quota") / F.lit(float(total or 1)))
             .withColumn("needed", F.ceil(F.col("quota") / block_words)))
    top = spans.agg(F.max("source_index")).first()[0]
    spans = spans.withColumn("hi", F.when(F.col("source_index") == F.lit(top), 2.0).otherwise(F.col("hi")))
    first, last = F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    spans = spans.withColumn("first_cell", F.greatest(F.least(first, F.lit(cells - 1)) - 1, F.lit(0)))
    by_cell = spans.select("source_index", "lo", "hi", "needed",
                           F.explode(F.sequence("first_cell", last.cast("long"))).alias("cell"))
    # an interval starts where the one before it ends, so that no point falls between
    by_cell = by_cell.withColumn("lo", F.when(F.col("source_index") == F.lit(
        spans.agg(F.min("source_index")).first()[0]), -1.0).otherwise(F.col("lo")))
    points = (spark.range(n_slots).select(F.col("id").alias("slot"),
                                          F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
              .withColumn("cell", F.floor(F.col("u") * cells)))
    slots = (points.join(by_cell, "cell")
             .filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
             .select("slot", "source_index", "needed", F.lit(1).alias("one"),
                     F.shiftright("slot", _SLOT_RUN).alias("run"),
                     F.shiftright("slot", _SLOT_BLOCK).alias("runs")))
    slots = materialise(slots.dropDuplicates(["slot"]), "mix-slots")
    ranked = common.prefix_sums(slots, ["source_index"], "runs", "run", ["slot"], "one", "block")
    used = ranked.filter(F.col("block") < F.col("needed")).select("slot", "source_index", "block")
    got = slots.groupBy("source_index").agg(F.count("slot").alias("got"))
    owed = (spans.join(got, "source_index", "left")
            .withColumn("got", F.coalesce("got", F.lit(0)))
            .filter(F.col("got") < F.col("needed"))
            .select("source_index", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("block"))
            .select((F.lit(n_slots) + F.col("block") * n_sources + F.col("source_index")).alias("slot"),
                    "source_index", "block"))
    return used.unionByName(owed)


def mix(docs: DataFrame, weights=cyclic_weights, block_words: int = BLOCK_WORDS,
        max_passes: int = MAX_PASSES, seed: int = SEED) -> Mix:
    """Deal the words of ``docs`` (doc_id, source, text) to the schedule.

    A null or empty text has size 0 and is never taken; a null source is a source of
    its own, ordered last; rows that repeat are documents of their own; an empty
    table gives empty results. Equal inputs give equal mixes: the order inside a
    source follows a seeded hash of the row. Every source ends within one word of
    its target, since its last block is cut where its quota ends.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{common.SPACE}]+")).cast("long")
    rows = materialise(docs.select("doc_id", "source", size.alias("size")), "mix-rows")
    sources = materialise(source_targets(rows, weights, max_passes), "mix-targets")
    bits = common.run_bits(rows.count())
    drawn = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    placed = (rows.withColumnRenamed("source", "_source")
              .join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
              .withColumn("draw", drawn)
              .withColumn("run", F.shiftrightunsigned("draw", 64 - bits))
              .withColumn("runs", F.shiftrightunsigned("run", bits // 2)))
    placed = common.prefix_sums(placed, ["source_index"], "runs", "run", ["draw", "doc_id"], "size", "start")
    nth = Window.partitionBy("source_index", "run").orderBy("draw", "doc_id")
    placed = materialise(placed.withColumn("nth", F.row_number().over(nth)), "mix-placed")

    copies = F.when((F.col("size") > 0) & (F.col("quota") > 0),
                    F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("source_size")).cast("int") - 1))
    laid = (placed.withColumn("pass", F.explode(copies))
            .withColumn("begin", F.col("pass") * F.col("source_size") + F.col("start"))
            .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
            .filter(F.col("begin") < F.col("end"))
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words),
                                                      F.floor((F.col("end") - 1) / block_words)))))
    at = F.greatest("begin", F.col("block") * block_words)
    to = F.least("end", (F.col("block") + 1) * block_words)
    pieces = (laid.join(schedule(spark, sources, block_words), ["source_index", "block"])
              .select("slot", "source_index", "block", "run", "nth", "doc_id", "pass",
                      (at - F.col("begin")).alias("from_word"), (to - F.col("begin")).alias("to_word")))
    taken = pieces.groupBy("source_index", "run", "nth").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    documents = (placed.join(taken, ["source_index", "run", "nth"], "left")
                 .select("doc_id", "source", "size", "source_size", "target",
                         F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
    return Mix(documents, pieces, sources)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    mixed = mix(common.table(spark, sf_dir, "documents")).documents
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")
