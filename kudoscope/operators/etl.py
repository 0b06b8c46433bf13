"""From raw records to the processed review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.functions.columns import compute_once
from kudoscope.operators.ranking import below_rate, draw_hash
from kudoscope.schemas import LABELS, REVIEW

# Provenance constants of the processed table, sampling target.
CATEGORY = "All_Beauty"
SOURCE = "amazon_reviews_2023"
SAMPLE_TARGET = 85_000
SAMPLE_SLACK = 1.05
SEED = 42


def sample_rate(total_rows: int, target: int = SAMPLE_TARGET) -> float:
    """Share of the source rows to keep so that about ``target`` remain."""
    return min(1.0, target * SAMPLE_SLACK / total_rows) if total_rows else 1.0


def bernoulli_sample(df: DataFrame, unique: Column, rate: float, seed: int = SEED) -> DataFrame:
    """Keep each row with probability ``rate``, repeatably; one narrow filter."""
    return df.filter(below_rate(draw_hash(unique, seed), rate))


def standardise(raw: DataFrame, category: str = CATEGORY, source: str = SOURCE,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw records in the processed schema plus ``drop_reason`` (null = usable so far).

    Keeps every row, so the funnel counts and the table come from one definition. Columns
    named by ``carry`` stay as they are.
    """
    body = tx.trim_spaces(F.coalesce(F.col("text"), F.lit("")))
    head = tx.trim_spaces(F.coalesce(F.col("title"), F.lit("")))
    product = F.coalesce(F.nullif(F.col("asin"), F.lit("")),
                         F.nullif(F.col("parent_asin"), F.lit("")), F.lit(""))
    named = raw.select(
        tx.review_id(F.col("user_id"), product, F.col("timestamp"), body).alias("review_id"),
        body.alias("text"), head.alias("title"),
        F.col("rating").try_cast("double").alias("rating"),
        product.alias("product"), F.lit(category).alias("category"), F.lit("").alias("price"),
        tx.epoch_ms_to_utc(F.col("timestamp")).alias("date"),
        F.coalesce(F.col("helpful_vote"), F.lit(0)).alias("helpful_votes"),
        F.coalesce(F.col("verified_purchase"), F.lit(False)).alias("verified_purchase"),
        labels.rating_to_sentiment(F.col("rating")).alias("sentiment"),
        F.lit(source).alias("source"),
        *[c for c in raw.columns if c == "row_order" or c in carry],
    )
    both = tx.combined_text(F.col("text"), F.col("title"))
    cleaned = compute_once(compute_once(named, _both=both),
                           clean_text=tx.clean_text(F.col("_both")))
    reason = (F.when(F.col("sentiment").isNull(), "invalid_rating")
              .when(F.col("_both") == "", "empty_text")
              .when(F.col("clean_text") == "", "empty_clean_text"))
    return cleaned.withColumn("drop_reason", reason).drop("_both")


def dedup_clean_text(df: DataFrame, order: str) -> DataFrame:
    """First row by ``order`` of every distinct ``clean_text``.

    Planned as a group limit of one on both sides of the shuffle: a text copied a
    billion times leaves each partition once.
    """
    window = Window.partitionBy("clean_text").orderBy(order)
    return (df.withColumn("_nth", F.row_number().over(window))
            .filter(F.col("_nth") == 1).drop("_nth"))


def processed_reviews(raw: DataFrame, order: str = "row_order") -> DataFrame:
    """The processed review table: usable rows, one per clean text."""
    usable = standardise(raw).filter(F.col("drop_reason").isNull())
    return dedup_clean_text(usable, order).select(*REVIEW.fieldNames())


def funnel(raw: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """One row of counters from raw rows down to usable rows.

    One pass: conditional counts plus one distinct count, which Spark reduces per
    partition before the shuffle. Texts are told apart by their SHA-256, so the
    shuffle moves fingerprints.
    """
    sampled = raw if sampled is None else sampled
    tagged = standardise(sampled).select(
        "drop_reason",
        F.when(F.col("drop_reason").isNull(), F.sha2("clean_text", 256)).alias("kept"))
    counts = tagged.agg(
        F.count(F.lit(1)).alias("sampled_rows"),
        F.count_if(F.col("drop_reason") == "invalid_rating").alias("invalid_rating"),
        F.count_if(F.col("drop_reason") == "empty_text").alias("empty_text"),
        F.count_if(F.col("drop_reason") == "empty_clean_text").alias("empty_clean_text"),
        F.count("kept").alias("_kept"),
        F.countDistinct("kept").alias("final_rows"),
    ).withColumn("duplicate_clean_text", F.col("_kept") - F.col("final_rows")).drop("_kept")
    if sampled is raw:
        return counts.withColumn("raw_rows", F.col("sampled_rows"))
    total = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("raw_rows", total)


def source_funnel(decoded: DataFrame) -> DataFrame:
    """One row of counters from the lines of a source down to usable rows, in one pass.

    ``decoded`` holds a row per line: the raw columns, ``drawn`` (in the sample) and
    ``decoded`` (a JSON object). The texts of other lines are emptied before cleaning, so
    they cost nothing, and all counters come from one aggregate. That aggregate is run
    again whole where an executor is lost, unlike counters observed beside a write,
    which count a repeated task twice. Empty source: all counters 0.
    """
    usable = F.coalesce(F.col("drawn") & F.col("decoded"), F.lit(False))
    emptied = decoded.withColumns({c: F.when(usable, F.col(c)) for c in ("rating", "text", "title")})
    tagged = standardise(emptied.withColumn("usable", usable), carry=("drawn", "usable")).select(
        "drawn", "usable", "drop_reason",
        F.when(F.col("drop_reason").isNull(), F.sha2("clean_text", 256)).alias("kept"))
    return tagged.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("drawn").alias("sampled_lines"),
        F.count_if(F.col("drawn") & ~F.col("usable")).alias("undecodable"),
        F.count_if("usable").alias("sampled_rows"),
        F.count_if(F.col("usable") & (F.col("drop_reason") == "invalid_rating")).alias("invalid_rating"),
        F.count_if(F.col("drop_reason") == "empty_text").alias("empty_text"),
        F.count_if(F.col("drop_reason") == "empty_clean_text").alias("empty_clean_text"),
        F.count("kept").alias("_kept"),
        F.countDistinct("kept").alias("final_rows"),
    ).withColumn("duplicate_clean_text", F.col("_kept") - F.col("final_rows")).drop("_kept")


def normalise_legacy(df: DataFrame, overwrite_text: bool = True) -> DataFrame:
    """Accept ``Review``+``Summary`` for ``text`` and ``Sentiment`` for ``sentiment``.

    Training overwrites an existing ``text``; plain preprocessing fills it only
    when it is absent (``overwrite_text=False``).
    """
    names = df.columns
    if {"Review", "Summary"} <= set(names):
        if overwrite_text or "text" not in names:
            df = df.withColumn("text", F.concat(F.coalesce("Review", F.lit("")), F.lit(" "),
                                                F.coalesce("Summary", F.lit(""))))
    elif "text" not in names:
        raise ValueError("reviews need a text column, or Review and Summary")
    if "sentiment" not in names:
        if "Sentiment" not in names:
            raise ValueError("reviews need a sentiment (or Sentiment) column")
        df = df.withColumnRenamed("Sentiment", "sentiment")
    return df


def preprocess(df: DataFrame, order: str, text_col: str = "text") -> DataFrame:
    """Training preparation: drop blank text and missing label, clean, dedup."""
    usable = df.filter(~tx.is_blank(F.col(text_col)) & F.col("sentiment").isNotNull())
    cleaned = compute_once(usable.drop("clean_text"), clean_text=tx.clean_text(F.col(text_col)))
    return dedup_clean_text(cleaned.filter(F.col("clean_text") != ""), order)


def quality_checks(df: DataFrame, source: str = SOURCE) -> DataFrame:
    """``(check_name, violations)`` for the six invariants of a processed table, in one pass.

    The values that must be unique fan out, two narrow rows to a review, and are counted with
    partial aggregates; the checks of a row travel with the first of them.
    """
    rows = {
        "non_empty_clean_text": tx.is_blank(F.col("clean_text")),
        "label_domain": ~F.coalesce(F.col("sentiment").isin(*LABELS), F.lit(False)),
        "rating_range": ~F.coalesce(F.col("rating").between(1, 5), F.lit(False)),
        "constant_source": ~F.coalesce(F.col("source") == source, F.lit(False)),
    }
    unique = {"unique_clean_text": F.sha2("clean_text", 256), "unique_review_id": F.col("review_id")}
    broken = F.struct(*[c.cast("long").alias(n) for n, c in rows.items()])
    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in rows])
    values = [F.struct(F.lit(n).alias("check"), c.alias("value"), (none if i else broken).alias("broken"))
              for i, (n, c) in enumerate(unique.items())]
    found = df.select(F.inline(F.array(*values))).groupBy("check", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"broken.{n}").alias(n) for n in rows])
    sums = [F.sum(n).alias(n) for n in rows]
    sums += [F.sum(F.when(F.col("check") == n, F.col("n") - 1)).alias(n) for n in unique]
    listed = [F.struct(F.lit(n).alias("check_name"), F.coalesce(n, F.lit(0).cast("long")).alias("violations"))
              for n in (*rows, *unique)]
    return found.agg(*sums).select(F.inline(F.array(*listed)))
