"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask of word offsets with gaps: the words in the gaps may differ.
Masks are slid along documents and items, and equal seeds give an alignment of the two,
along which the words of the whole item are compared. The masks are chosen so that no
set of words that may be changed spoils all of them: found by search, and proven by
exhaustion for items of up to 39 words. A longer item splits into pieces of 20 to 39
words, one of which holds no more than its share of the changed words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.llm import common
from kudoscope.session import materialise

# Masks by the least number of words of the items they serve, a fifth of which may change.
MASKS = {
    7: ((0, 1, 3, 4),),
    10: ((0, 1, 2, 4), (0, 1, 3, 6)),
    15: ((0, 1, 2, 4, 6, 7), (0, 1, 3, 8, 10, 11), (0, 1, 3, 4, 7, 8), (0, 1, 2, 3, 4, 7)),
}
TOLERANT = min(MASKS)  # words from which an item may have words changed; shorter ones count as a whole
MIN_WORDS = 3          # shorter items are no evidence and are left out
MIN_OVERLAP = 0.8      # share of an item's words, or of a stretch's; the masks are good for no less
STRETCH = 20           # words of a long item that count as a passage of their own


def plain_words(text: Column) -> Column:
    """Lower-cased words without anything but letters and digits; null gives none."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]+", "")
    return common.words(bare)


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """Word offsets of the seeds of an item of ``n`` words; all its words for a short one."""
    return MASKS[max(least for least in MASKS if least <= n)] if n >= TOLERANT else (tuple(range(n)),)


def _seeds(df: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``keep`` plus ``position, mask, seed`` for every place of a mask in ``words``.

    Words are hashed once, seeds are hashes of those; the words go no further.
    """
    n = F.size("codes")

    def seed(at: int, mask: tuple[int, ...]) -> Column:
        value = F.xxhash64(F.lit(at), *[F.get("codes", F.col("position") + o) for o in mask])
        return F.when(F.col("position") + mask[-1] < n, value)

    masks = masks or [(0,)]
    shortest = min(m[-1] for m in masks)
    spots = F.when(n > shortest, F.sequence(F.lit(0), n - shortest - 1))
    return (df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
            .select(*keep, "codes", F.explode(spots).alias("position"))
            .select(*keep, "position", F.posexplode(F.array(*[seed(i, m) for i, m in enumerate(masks)]))
                    .alias("mask", "seed"))
            .filter(F.col("seed").isNotNull()))


def item_table(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_key, item_words, n_item`` of the items long enough to count; one row per item text."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("item_words"))
    return (items.withColumns({"n_item": F.size("item_words"),
                               "item_key": F.xxhash64(F.array_join("item_words", " "))})
            .filter(F.col("n_item") >= MIN_WORDS).dropDuplicates(["item_id", "item_key"]))


def _equal_words(shift: Column) -> Column:
    """1 for each word of ``item_words`` that equals the word of ``words`` it lies on, else 0."""
    return F.transform("item_words", lambda w, i: F.coalesce(
        F.when((shift + i >= 0) & (F.get("words", shift + i) == w), 1), F.lit(0)))


def _same_text(other: DataFrame) -> Column:
    """That a row's ``doc_id, text_key`` are those of ``other``, named ``id, key`` there."""
    return F.col("doc_id").eqNullSafe(other["id"]) & (F.col("text_key") == other["key"])


def contamination(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Pairs ``doc_id, text_key, item_id, overlap, stretch`` of documents that hold an item.

    A pair counts if, along one alignment, at least ``min_overlap`` (0.8 or more) of the
    item's words are equal, or of one stretch of 20 words in a longer item. Null or empty
    texts hold nothing; rows that repeat give one pair; a null id is an id like any other;
    empty tables give an empty result; columns beyond doc_id, text and item_id, text are
    not read. Items of 3 to 6 words count only where all their words stand in a row,
    shorter ones never.

    Seeds, alignments and items are broadcast only when counted to be few, otherwise
    their joins are shuffled; only documents with an alignment are read a second time
    and compared, once for each distinct alignment.
    """
    if min_overlap < MIN_OVERLAP:
        raise ValueError(f"the seeds are good for an overlap of {MIN_OVERLAP} or more")
    items = materialise(item_table(benchmark), "decontam-items")
    lengths = [r[0] for r in items.select("n_item").distinct().collect()]
    of_length: dict[tuple[int, ...], list[int]] = {}
    for n in sorted(lengths):
        for mask in masks_of(n):
            of_length.setdefault(mask, []).append(n)
    masks = list(of_length)
    fits = F.lit(False)
    for at, mask in enumerate(masks):
        fits = fits | (F.col("mask") == at) & F.col("n_item").isin(of_length[mask])
    texts = items.select("item_key", "n_item", F.col("item_words").alias("words")).dropDuplicates(["item_key"])
    seeds = (_seeds(texts, ["item_key", "n_item"], masks).filter(fits)
             .select("item_key", F.col("position").alias("item_position"), "seed").distinct())
    seeds = materialise(seeds, "decontam-seeds")

    def narrow(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if common.small_enough(df) else df

    keyed = docs.select("doc_id", common.text_key(F.col("text")).alias("text_key"), "text")
    worded = keyed.select("doc_id", "text_key", plain_words(F.col("text")).alias("words"))
    alignments = (_seeds(worded, ["doc_id", "text_key"], masks).join(narrow(seeds), "seed")
                  .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "item_key",
                          (F.col("position") - F.col("item_position")).alias("shift")).distinct())
    alignments = materialise(alignments, "decontam-alignments")
    held = narrow(alignments.select("id", "key").distinct())
    words = (keyed.join(held, _same_text(held), "left_semi")
             .select("doc_id", "text_key", plain_words(F.col("text")).alias("words")))
    n_words = items.agg(F.sum("n_item")).first()[0] or 0
    whole = F.broadcast(items) if n_words <= common.BROADCAST_ROWS else items
    met = narrow(alignments)
    hits = words.join(met, _same_text(met)).join(whole, "item_key")
    shift = F.col("shift")
    summed = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    running = F.transform(F.sequence(F.lit(0), F.size("same") - STRETCH),
                          lambda i: F.aggregate(F.slice("same", i + 1, STRETCH), F.lit(0), lambda a, x: a + x))
    scored = (hits.select("doc_id", "text_key", "item_id", "n_item",
                          F.explode(F.array(_equal_words(shift))).alias("same"))
              .select("doc_id", "text_key", "item_id", (summed / F.col("n_item")).alias("overlap"),
                      F.when(F.col("n_item") > STRETCH, F.array_max(running) / F.lit(float(STRETCH)))
                      .otherwise(F.lit(0.0)).alias("stretch"))
              .filter((F.col("overlap") >= min_overlap) | (F.col("stretch") >= min_overlap)))
    return scored.groupBy("doc_id", "text_key", "item_id").agg(
        F.max("overlap").alias("overlap"), F.max("stretch").alias("stretch"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns, whatever their names.

    Null and empty texts hold nothing and stay; rows that repeat stay or go together.
    """
    found = contamination(docs, benchmark, **options).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    found = materialise(found, "decontam-found")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", common.text_key(F.col("text")).alias("text_key"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")),
                     "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the overlap."""
    return contamination(common.table(spark, sf_dir, "documents"),
                         common.table(spark, sf_dir, "benchmark")).drop("text_key")
