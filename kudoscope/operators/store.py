"""The stored tables: reviews, predictions, metrics, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.operators import analytics, filters
from kudoscope.schemas import METRIC, STORED_REVIEW
from kudoscope.session import materialise

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stored_review_rows(reviews: DataFrame) -> DataFrame:
    """Rows of the review table for a scored batch, one per review id; blank texts are not stored."""
    return (reviews.filter(~tx.is_blank(F.col("text")))
            .select(*[F.col(f.name).cast(f.dataType) for f in STORED_REVIEW]).dropDuplicates(["review_id"]))


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Log rows of a scored table. Ids are hashes of review, model and time of the run: a
    retried batch repeats them, a later prediction of the same review has its own.

    Blank texts were answered without a model and are not logged.
    """
    return scored.filter(~tx.is_blank(F.col("text"))).select(
        tx.hashed_id("pred_", F.col("review_id"), F.col("model_used"),
                     F.date_format(F.col("timestamp").cast("timestamp"), STAMP)).alias("prediction_id"),
        "review_id", "sentiment", "confidence", "model_requested", "model_used", "timestamp")


def blank_gate(scored: DataFrame, text_col: str = "text") -> DataFrame:
    """Blank texts of a batch come back neutral, without confidence and unlogged."""
    blank = tx.is_blank(F.col(text_col))
    return scored.withColumns({
        "sentiment": F.when(blank, "neutral").otherwise(F.col("sentiment")),
        "confidence": F.when(~blank, F.col("confidence")),
        "logged": ~blank})


def reviews_by_prediction(reviews: DataFrame, predictions: DataFrame,
                          sentiment: str | None = None, product: str | None = None) -> DataFrame:
    """Stored reviews joined to their predictions, filtered before the join."""
    if sentiment:
        predictions = predictions.filter(F.col("sentiment") == sentiment.lower().strip())
    if product:
        reviews = reviews.filter(F.col("product") == product)
    return reviews.join(predictions, "review_id")


def stored_reviews(reviews: DataFrame, predictions: DataFrame, product: str | None = None,
                   sentiment: str | None = None, skip: int = 0, limit: int = 100,
                   order: str = "review_id") -> DataFrame:
    """A page of stored reviews by product and/or predicted sentiment."""
    if sentiment:
        rows = reviews_by_prediction(reviews, predictions, sentiment, product)
        rows = rows.select(*[F.col(c) for c in reviews.columns])
    else:
        rows = reviews.filter(F.col("product") == product) if product else reviews
    return filters.paginate(rows, skip, limit, order)


def store_totals(reviews: DataFrame, predictions: DataFrame) -> DataFrame:
    """Row counts of both tables."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
    return rows(reviews, "reviews").unionByName(rows(predictions, "predictions"))


def read_metrics(metrics: DataFrame) -> DataFrame:
    """Stored metrics with their fallbacks filled in."""
    return metrics.withColumns({
        "macro_precision": F.coalesce("macro_precision", "precision"),
        "macro_recall": F.coalesce("macro_recall", "recall"),
        "macro_f1": F.coalesce("macro_f1", "f1")})


def upsert_metrics(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest record per model; columns may be added, missing ones are null."""
    def complete(df: DataFrame) -> DataFrame:
        for field in METRIC:
            if field.name not in df.columns:
                df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
        return df

    fresh = complete(incoming)
    fresh = fresh.withColumns({
        "macro_precision": F.coalesce("macro_precision", "precision"),
        "macro_recall": F.coalesce("macro_recall", "recall"),
        "macro_f1": F.coalesce("macro_f1", "f1")}).withColumn("f1", F.col("macro_f1"))
    both = (complete(stored).withColumn("_fresh", F.lit(0))
            .unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True))
    latest = Window.partitionBy("model_name").orderBy(
        F.col("_fresh").desc(), F.col("evaluated_at").desc_nulls_last())
    return (both.withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") == 1)
            .drop("_nth", "_fresh"))


def _entries(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"),
                     value.cast("double").alias("value"))


def distribution_entries(reviews: DataFrame) -> DataFrame:
    """Class and rating distribution as ``(section, name, value)`` rows.

    The reviews are passed once: their counts by class and rating are written, and the parts
    read these few rows.
    """
    counted = materialise(reviews.groupBy("sentiment", "rating").agg(F.count(F.lit(1)).alias("rows")), "distribution")
    classes = analytics.class_distribution(counted, rows="rows")
    stars = analytics.rating_distribution(counted, rows="rows")
    out = None
    for df, key, section in ((classes, "sentiment", "class"), (stars, "rating", "rating")):
        for what, value in (("count", F.col("count")),
                            ("percentage", F.round("percentage", 2))):
            part = _entries(df, f"{section}_{what}", F.col(key), value)
            out = part if out is None else out.unionByName(part)
    return out


def funnel_entries(funnel: DataFrame) -> DataFrame:
    """Counters of an ETL funnel as ``(section, name, value)`` rows."""
    long = funnel.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in funnel.columns])))
    return _entries(long, "funnel", F.col("name"), F.col("value"))


def dashboard_entries(reviews: DataFrame, predictions: DataFrame, metrics: DataFrame,
                      keywords: DataFrame) -> DataFrame:
    """The dashboard bundle in long form: totals, metrics, keywords, distributions."""
    totals = _entries(store_totals(reviews, predictions), "totals", F.col("table"), F.col("rows"))
    out = totals.unionByName(distribution_entries(reviews))
    for metric in ("accuracy", "macro_f1", "weighted_f1"):
        out = out.unionByName(_entries(metrics, metric, F.col("model_name"), F.col(metric)))
    words = F.concat_ws(":", F.col("class"), F.col("term"))
    return out.unionByName(_entries(keywords, "keywords", words, F.col("rank")))


def bundle(entries: DataFrame) -> DataFrame:
    """Fold ``(section, name, value)`` rows into one row: section -> name -> value.

    For the aggregated entries above only, a few dozen rows in all.
    """
    sections = entries.groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("items"))
    return sections.agg(F.map_from_entries(F.collect_list(F.struct("section", "items")))
                        .alias("document"))
