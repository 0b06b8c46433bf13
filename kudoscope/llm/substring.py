"""Substring deduplication with difference-cover anchors.

A perfect difference set D modulo v holds, for every two offsets, a shift of less
than v that takes both to positions in D. Hashing the words that follow only the
positions in D (6 of 31) therefore gives any two equal passages of 50 words an anchor
at the same place in both. Where an anchor occurs in more than one document, the
windows of 50 words around it are hashed whole and settle what is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.functions.columns import compute_once
from kudoscope.llm import common
from kudoscope.session import discard, materialise

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # perfect difference set modulo 31


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.text_key(F.col("text")).alias("text_key"),
                       common.words(F.col("text")).alias("words"))


def anchors(tokens: DataFrame, window: int = WINDOW, period: int = PERIOD, cover=COVER) -> DataFrame:
    """``doc_id, text_key, at, anchor`` at the cover positions of every document of a window or more.

    An anchor reads ``window - period + 1`` words, so that it lies inside the window
    whichever of the first ``period`` places it stands at.
    """
    width, n = window - period + 1, F.size("words")
    blocks = F.when(n >= window, F.sequence(F.lit(0), F.floor((n - width) / period).cast("int")))
    places = F.array(*[F.lit(c) for c in cover])
    return (tokens.select("doc_id", "text_key", "words", F.explode(blocks).alias("block"))
            .select("doc_id", "text_key", "words", "block", F.explode(places).alias("place"))
            .withColumn("at", F.col("block") * period + F.col("place"))
            .filter(F.col("at") + width <= F.size("words"))
            .select("doc_id", "text_key", "at",
                    F.xxhash64(F.slice("words", F.col("at") + 1, F.lit(width))).alias("anchor")))


def shared_anchors(found: DataFrame) -> DataFrame:
    """The anchors that occur under more than one doc_id."""
    return (found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .filter(F.col("low") < F.col("high")).select("anchor"))


def _runs(places: Column, gap: Column | int) -> Column:
    """Ascending places as runs ``first, last``: a new run where the step exceeds ``gap``."""
    first = F.filter(places, lambda p, i: (i == 0) | (p - F.get(places, i - 1) > gap))
    last = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) - p > gap))
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover=COVER) -> DataFrame:
    """``doc_id, text_key, starts``: ascending starts of the windows that a smaller doc_id also holds.

    Every window is compared through two 64-bit hashes with the smallest doc_id that
    holds it; no pair of documents is ever formed, so a passage in a third of all
    documents costs a row for each of its places.
    """
    width = window - period + 1
    found = materialise(anchors(_tokens(docs), window, period, cover), "substring-anchors")
    shared = materialise(shared_anchors(found), "substring-shared")
    hit = found.join(shared, "anchor").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set("at")).alias("hits"))
    hit = materialise(hit, "substring-hits")
    discard(found)
    # windows that hold a shared anchor: from window - width words before it to its own place
    keyed = hit.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "hits")
    # texts meet their hits as they are: cut into words they take twice the room
    own = docs.select("doc_id", "text", common.text_key(F.col("text")).alias("text_key"))
    wide = own.join(keyed, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")))
    wide = wide.select("doc_id", "text_key", "hits", common.words(F.col("text")).alias("words"))
    runs = _runs(F.col("hits"), window - width)
    spans = F.transform(runs, lambda r: F.sequence(
        F.greatest(r["first"] - (window - width), F.lit(0)), F.least(r["last"], F.size("words") - window)))
    here = F.slice("words", F.col("at") + 1, F.lit(window))
    windows = (wide.select("doc_id", "text_key", "words", F.explode(spans).alias("span"))
               .select("doc_id", "text_key", "words", F.explode("span").alias("at"))
               .select("doc_id", "text_key", "at", F.xxhash64(here).alias("h1"),
                       F.xxhash64(F.lit(window), here).alias("h2")))
    windows = materialise(windows, "substring-windows")
    low = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    low = materialise(low.filter("low < high").drop("high"), "substring-low")
    starts = materialise(windows.join(low, ["h1", "h2"]).filter(F.col("doc_id") > F.col("low"))
                         .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("starts")),
                         "substring-starts")
    discard(windows)
    return starts


def strip_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Rows of ``docs`` with ``words, kept`` (arrays) and ``removed`` (runs ``first, last`` of words).

    A word goes if a window over it also starts in a document with a smaller doc_id;
    windows are judged on the input. Equal passages inside one document, or in rows that
    share a doc_id, stay. A row with null doc_id is no smaller or larger than any and
    stays whole. Null and blank texts have no words. Rows that repeat give as many rows;
    other columns stay, except those that bear the three names, which are replaced.
    """
    docs = docs.drop("words", "kept", "removed")
    starts = repeated_windows(docs, window, **options)
    starts = starts.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "starts")
    runs = F.transform(_runs(F.col("starts"), window), lambda r: F.struct(
        r["first"].alias("first"), (r["last"] + window - 1).alias("last")))
    # whole texts travel, and become words where they arrive
    rows = docs.select(F.struct("*").alias("row"), "doc_id", common.text_key(F.col("text")).alias("text_key"))
    met = rows.join(starts, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    joined = (compute_once(met, words=common.words(F.col("row.text")))
              .withColumn("removed", F.coalesce(runs, F.array().cast("array<struct<first:int,last:int>>"))))
    n = F.size("removed")
    edges = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i == 0, 0).otherwise(F.get("removed", i - 1)["last"] + 1).alias("from"),
        F.when(i == n, F.size("words")).otherwise(F.get("removed", i)["first"]).alias("to")))
    kept = F.flatten(F.transform(edges, lambda e: F.slice("words", e["from"] + 1, e["to"] - e["from"])))
    return joined.select("row.*", "removed", kept.alias("kept"), "words")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words, of those removed, and a digest of the rest."""
    done = strip_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("words").cast("long").alias("n_words"),
                       (F.size("words") - F.size("kept")).cast("long").alias("n_removed"),
                       F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256"))
