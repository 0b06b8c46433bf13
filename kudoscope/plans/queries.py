"""Named queries over the test tables: one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kudoscope.functions import labels, rules, text as tx
from kudoscope.functions.columns import compute_once
from kudoscope.operators import (analytics, attribution, etl, evaluation, filters, keyphrases,
                                 linear, models, splitting, store, vectorise)
from kudoscope.plans import adapters as ad, pipelines
from kudoscope.schemas import LABELS
from kudoscope.session import materialise, work_dir
from kudoscope.sources import readers, sinks
from kudoscope.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _pct(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round shares for display."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- sources
@query
def raw_json_parse(spark, sf):
    events = ad.table(spark, sf, "events").select("event_id", "props")
    return readers.parse_json(events, "props", StructType.fromDDL("k int")).drop("props")


@query
def source_row_count(spark, sf):
    return readers.source_row_count(ad.table(spark, sf, "events"))


@query
def load_reviews(spark, sf):
    loaded = readers.apply_review_defaults(ad.loosely_typed(spark, sf))
    return loaded.withColumn("date_dt", F.date_format("date_dt", "yyyy-MM-dd HH:mm:ss")).drop("date")


@query
def dataset_summary(spark, sf):
    return store.distribution_entries(etl.processed_reviews(ad.raw_reviews(spark, sf)))


@query
def raw_jsonl_roundtrip(spark, sf):
    """Lines with fields of other types, and some that do not decode, through the real reader."""
    path = work_dir(spark, "raw-lines")
    ad.mistyped_lines(spark, sf).write.text(path)
    missing = F.lit(-1)
    return readers.read_raw_reviews(spark, path).select(
        "asin", "rating", "text", F.coalesce("timestamp", missing.cast("long")).alias("timestamp"),
        F.coalesce("helpful_vote", missing).alias("helpful_vote"), "verified_purchase")


@query
def raw_line_counts(spark, sf):
    return readers.line_counts(ad.mistyped_lines(spark, sf))


@query
def reviews_csv_roundtrip(spark, sf):
    path = work_dir(spark, "reviews-csv")
    (ad.csv_reviews(spark, sf).write.option("header", True).option("escape", '"').csv(path))
    loaded = readers.load_reviews(spark, path, fmt="csv")
    return loaded.select("review_id", "text", "rating", "helpful_votes", "verified_purchase",
                         F.date_format("date_dt", "yyyy-MM-dd HH:mm:ss").alias("date_dt"))


@query
def batch_csv_source(spark, sf):
    docs = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id", "left")
    path = work_dir(spark, "batch-csv")
    docs.select("doc_id", "quality").write.option("header", True).csv(path)
    return readers.read_batch_csv(spark, path, "quality")


@query
def batch_lines_source(spark, sf):
    return readers.pasted_lines(ad.table(spark, sf, "documents"), "text", "doc_id")


@query
def product_audit_export(spark, sf):
    return analytics.product_audit(ad.text_reviews(spark, sf))


@query
def catalogue_audit(spark, sf):
    """The whole catalogue written in ranges of products and read back by the manifest's files."""
    path = work_dir(spark, "catalogue-audit")
    sinks.write_catalogue_audit(ad.text_reviews(spark, sf), path)
    held = readers.catalogue_manifest(spark, path)
    rows = readers.read_catalogue_audit(spark, path)
    found = rows.groupBy("product").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if("verified_purchase").alias("verified"),
        F.sum(F.length("text")).alias("text_length"))
    return (held.groupBy("product").agg(F.sum("rows").alias("rows_listed"))
            .join(found.withColumnRenamed("product", "_p"), F.col("product").eqNullSafe(F.col("_p")), "full")
            .drop("_p"))


@query
def place_payload_flatten(spark, sf):
    flat = readers.flatten_place_reviews(readers.place_details(ad.place_payloads(spark, sf)))
    return flat.select("place_id", "name", "maps_uri",
                       F.col("review.text.text").alias("body"),
                       F.col("review.originalText.text").alias("original"),
                       F.col("review.rating").alias("rating"),
                       F.col("review.authorAttribution.displayName").alias("author"),
                       F.col("review.publishTime").alias("publish_time"))


@query
def place_payload_mixed_types(spark, sf):
    """Payloads whose fields have other types, plain texts and empty text objects."""
    places = readers.place_details(ad.mixed_payloads(spark, sf))
    reviews = readers.unified_place_reviews(places).select("place_id", "text", "product", F.col("rating").alias("stars"))
    return reviews.join(places.select("place_id", "rating", "user_rating_count"), "place_id")


@query
def place_search_flatten(spark, sf):
    return readers.place_search(ad.search_payloads(spark, sf)).select(
        "query", "place_id", "name", "address", "user_rating_count", "rank")


@query
def payload_status_class(spark, sf):
    events = ad.table(spark, sf, "events").select(
        "event_id", ad.pick(ad.STATUSES, F.col("event_id") % 5).alias("status"))
    details = readers.response_class(F.col("status"))
    search = readers.response_class(F.col("status"), details=False)
    return events.select("event_id", "status", details["success"].alias("success"),
                         details["error"].alias("details_error"),
                         search["error"].alias("search_error"))


@query
def prediction_log(spark, sf):
    scored = ad.text_lines(spark, sf).select(
        F.concat_ws("_", "doc_id", "line_no").alias("review_id"), "text", "sentiment", "confidence",
        F.lit("linearsvc").alias("model_requested"), F.lit("linearsvc").alias("model_used"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"))
    return store.prediction_rows(scored).drop("timestamp")


def _coefficients(spark, sf) -> DataFrame:
    """The stand-in coefficients as the stored table they are in practice."""
    return materialise(ad.stand_in_coefficients(spark, sf), "coefficients")


def _metrics(spark, sf, rows=None) -> DataFrame:
    judged = ad.judged(ad.relational_reviews(spark, sf) if rows is None else rows)
    cells = evaluation.confusion_cells(judged, keys=["model_name"])
    m = evaluation.classification_metrics(cells, ["model_name"])
    # one model in an old shape without its macro columns
    old = F.col("model_name") == "linearsvc"
    return m.withColumns({"precision": F.col("macro_precision"), "recall": F.col("macro_recall"),
                          "f1": F.col("macro_f1")}).withColumns({
        c: F.when(~old, F.col(c)) for c in ("macro_precision", "macro_recall", "macro_f1")})


@query
def metrics_read(spark, sf):
    return store.read_metrics(_metrics(spark, sf))


@query
def metrics_upsert(spark, sf):
    r = ad.relational_reviews(spark, sf)
    stored = (_metrics(spark, sf, r.filter("verified_purchase"))
              .select("model_name", "accuracy", "f1"))
    incoming = _metrics(spark, sf, r.filter("NOT verified_purchase")).filter(
        F.col("model_name") != "logistic_regression")
    return store.upsert_metrics(stored, incoming).select(
        "model_name", "accuracy", "f1", "macro_f1", "weighted_f1")


# ---------------------------------------------------------------- projections, filters
@query
def rating_to_sentiment(spark, sf):
    li = ad.table(spark, sf, "lineitem").select((F.col("l_quantity") / 8).alias("rating"))
    return (li.groupBy("rating").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("sentiment", labels.rating_to_sentiment(F.col("rating"))))


@query
def combined_text(spark, sf):
    both = tx.combined_text(F.col("text"), F.col("title"))
    return (compute_once(ad.raw_reviews(spark, sf), combined=both)
            .select("row_order", "combined").filter(F.col("combined") != ""))


@query
def legacy_normalise(spark, sf):
    old = ad.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_order"), F.col("text").alias("Review"),
        F.nullif(F.col("lang"), F.lit("en")).alias("Summary"), F.col("source").alias("Sentiment"))
    return etl.normalise_legacy(old).select("row_order", "text", "sentiment")


@query
def preprocess_reviews(spark, sf):
    return etl.preprocess(ad.labelled_texts(spark, sf), "row_order").select(
        "row_order", "sentiment", "clean_text")


@query
def filter_reviews(spark, sf):
    return filters.filter_reviews(
        ad.text_reviews(spark, sf), products=["src1", "src2", "src3", "src8"],
        ratings=[1, "2", "4.0", "x"], sentiments=["Negative", "POSITIVE"],
        verified_only=True).select("row_order", "product", "rating", "sentiment")


@query
def search_reviews(spark, sf):
    return filters.filter_reviews(ad.text_reviews(spark, sf), search=" Refund|pump.?doesn ").select(
        "row_order", "product", "title")


@query
def mismatch_flag(spark, sf):
    r = ad.relational_reviews(spark, sf)
    return r.select("review_id", "rating", "sentiment",
                    labels.is_mismatch(F.col("rating"), F.col("sentiment")).alias("is_mismatch"))


@query
def feed_aspect_filter(spark, sf):
    return filters.aspect_filter(ad.text_reviews(spark, sf), "Delivery").select(
        "row_order", "product", "rating")


@query
def stored_reviews(spark, sf):
    reviews, predictions = ad.stored_tables(spark, sf)
    return store.stored_reviews(reviews, predictions, product="P7", sentiment=" Positive ",
                                skip=5, limit=50)


@query
def batch_blank_gate(spark, sf):
    return store.blank_gate(ad.text_lines(spark, sf)).drop("text")


@query
def batch_sentiment_counts(spark, sf):
    return analytics.label_counts(store.blank_gate(ad.text_lines(spark, sf)))


def _unified_places(spark, sf) -> DataFrame:
    return readers.unified_place_reviews(readers.place_details(ad.place_payloads(spark, sf)))


@query
def place_reviews_unified(spark, sf):
    return _unified_places(spark, sf)


@query
def quality_checks(spark, sf):
    return etl.quality_checks(etl.standardise(ad.raw_reviews(spark, sf)))


# ---------------------------------------------------------------- joins
@query
def reviews_by_prediction(spark, sf):
    return store.reviews_by_prediction(*ad.stored_tables(spark, sf), sentiment="Negative")


def _prepared_split(spark, sf) -> DataFrame:
    prepared = etl.preprocess(ad.labelled_texts(spark, sf), "row_order")
    return splitting.stratified_split(materialise(prepared, "prepared"))


@query
def split_leakage(spark, sf):
    return splitting.split_leakage(_prepared_split(spark, sf))


# ---------------------------------------------------------------- aggregates
@query
def class_distribution(spark, sf):
    return _pct(analytics.class_distribution(ad.relational_reviews(spark, sf)), "percentage")


@query
def rating_distribution(spark, sf):
    return _pct(analytics.rating_distribution(ad.relational_reviews(spark, sf)), "percentage")


@query
def etl_funnel(spark, sf):
    return etl.funnel(ad.raw_reviews(spark, sf))


@query
def etl_line_funnel(spark, sf):
    return pipelines.line_funnel(ad.review_lines(spark, sf))


@query
def store_totals(spark, sf):
    return store.store_totals(*ad.stored_tables(spark, sf))


@query
def prediction_distribution(spark, sf):
    return analytics.label_counts(ad.stored_tables(spark, sf)[1])


@query
def product_counts(spark, sf):
    return analytics.product_counts(ad.stored_tables(spark, sf)[0])


@query
def product_catalog(spark, sf):
    return analytics.product_catalog(ad.relational_reviews(spark, sf))


@query
def sentiment_pulse(spark, sf):
    return _pct(analytics.sentiment_pulse(ad.relational_reviews(spark, sf)),
                *[f"{c}_pct" for c in LABELS])


@query
def place_pulse(spark, sf):
    scored = _unified_places(spark, sf).withColumn(
        "sentiment", ad.pick(LABELS, F.length("text") % 3))
    return analytics.place_pulse(scored)


@query
def quarterly_trend(spark, sf):
    return analytics.quarterly_trend(ad.relational_reviews(spark, sf))


@query
def mismatch_summary(spark, sf):
    return _pct(analytics.mismatch_summary(ad.relational_reviews(spark, sf)), "mismatch_rate")


@query
def complaint_summary(spark, sf):
    return _pct(analytics.complaint_summary(ad.text_reviews(spark, sf)), "share_pct")


@query
def product_complaints(spark, sf):
    return _pct(analytics.product_complaints(ad.text_reviews(spark, sf)), "share_pct")


@query
def top_issue_per_aspect(spark, sf):
    return analytics.top_issue_per_aspect(ad.text_reviews(spark, sf))


@query
def high_priority_count(spark, sf):
    return analytics.high_priority_count(ad.text_reviews(spark, sf))


@query
def product_kpis(spark, sf):
    kpis = analytics.product_kpis(ad.relational_reviews(spark, sf))
    return _pct(kpis, *[f"{c}_pct" for c in LABELS], "avg_rating", "verified_pct").withColumns({
        c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


@query
def product_compare(spark, sf):
    compared = analytics.product_compare(ad.relational_reviews(spark, sf),
                                         ["P7", "P3", "P11", "P5"])
    return _pct(compared, *LABELS)


@query
def aspect_share(spark, sf):
    return analytics.aspect_share(analytics.product_complaints(ad.text_reviews(spark, sf)))


@query
def purchase_confidence(spark, sf):
    kpis = analytics.product_kpis(ad.relational_reviews(spark, sf))
    return _pct(analytics.purchase_confidence(kpis), "score")


@query
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(
        evaluation.confusion_cells(ad.judged(ad.relational_reviews(spark, sf))))


def _cells(spark, sf) -> DataFrame:
    return evaluation.confusion_cells(ad.judged(ad.relational_reviews(spark, sf)),
                                      keys=["model_name"])


@query
def classification_metrics(spark, sf):
    return evaluation.classification_metrics(_cells(spark, sf), ["model_name"])


@query
def classification_report(spark, sf):
    return evaluation.classification_report(_cells(spark, sf), ["model_name"])


@query
def class_weights(spark, sf):
    return _pct(evaluation.class_weights(ad.labelled_texts(spark, sf)), "weight")


@query
def model_comparison(spark, sf):
    return evaluation.model_comparison(
        _metrics(spark, sf).withColumn("latency", F.col("accuracy") / 1000))


@query
def dashboard_stats(spark, sf):
    keywords = models.class_keywords(_coefficients(spark, sf), 10)
    return store.dashboard_entries(ad.relational_reviews(spark, sf),
                                   ad.stored_tables(spark, sf)[1],
                                   store.read_metrics(_metrics(spark, sf)), keywords)


@query
def label_domain(spark, sf):
    return analytics.label_domain(ad.labelled_texts(spark, sf))


# ---------------------------------------------------------------- windows
@query
def dedup_clean_text(spark, sf):
    docs = compute_once(
        ad.table(spark, sf, "documents").select(F.col("doc_id").alias("row_order"), "text"),
        clean_text=tx.clean_text(F.col("text"))).drop("text")
    return etl.dedup_clean_text(docs.filter(F.col("clean_text") != ""), "row_order")


@query
def aspect_evidence(spark, sf):
    return analytics.aspect_evidence(ad.text_reviews(spark, sf)).select(
        "product", "aspect", "rank", "row_order", "stars", "issue", "priority", "safe_title")


@query
def stratified_split(spark, sf):
    return splitting.stratified_split(ad.text_reviews(spark, sf)).select(
        "review_id", "sentiment", "is_test")


@query
def stratified_sample(spark, sf):
    # the sample passes over its input several times; hash the ids of the rows once
    rows = readers.spread(ad.relational_reviews(spark, sf).select("review_id", "sentiment", "rating"))
    return splitting.stratified_sample(materialise(rows, "sampled"), 200).select(
        "review_id", "sentiment", "rating")


@query
def class_keywords(spark, sf):
    return models.class_keywords(_coefficients(spark, sf), 10)


@query
def ranked_concerns(spark, sf):
    summary = analytics.complaint_summary(ad.text_reviews(spark, sf))
    return _pct(analytics.rank_concerns(summary), "share_pct").withColumn(
        "is_next_step", F.col("rank") <= 3)


# ---------------------------------------------------------------- sorts, limits, samples
@query
def review_feed(spark, sf):
    page = filters.feed_page(ad.text_reviews(spark, sf), "Most Helpful", page_size=25)
    return page.select("review_id", "rating", "helpful_votes", "stars", "snippet", "day", "issue",
                       "primary_aspect", "priority", "is_mismatch")


@query
def review_feed_recent(spark, sf):
    page = filters.feed_page(ad.text_reviews(spark, sf), "Most Recent", "Packaging", page_size=50)
    return page.select("review_id", "day", "primary_aspect")


@query
def review_feed_total(spark, sf):
    return filters.feed_total(ad.text_reviews(spark, sf), "Lowest Rating", "Delivery", page_size=50)


@query
def feed_mismatch_only(spark, sf):
    return filters.feed_rows(ad.text_reviews(spark, sf), filters.MISMATCH_ONLY).select(
        "review_id", "rating", "sentiment")


@query
def deep_page(spark, sf):
    """A page behind 1,200 reviews, found by counts of key ranges."""
    page = filters.deep_page(ad.relational_reviews(spark, sf), 1200, 50, enough=100)
    return page.select("review_id", "product", "rating")


@query
def paginate_reviews(spark, sf):
    return filters.paginate(ad.relational_reviews(spark, sf), 100, 50).select(
        "review_id", "product", "rating")


@query
def mismatch_samples(spark, sf):
    return filters.mismatch_samples(ad.text_reviews(spark, sf)).select(
        "kind", "rank", "review_id", "rating", "excerpt", "primary_aspect", "issue",
        "suggested_action")


@query
def bernoulli_sample(spark, sf):
    r = ad.relational_reviews(spark, sf).select("review_id", "rating")
    return etl.bernoulli_sample(r, F.col("review_id"), 0.3)


@query
def sample_cap(spark, sf):
    return filters.sample_cap(ad.relational_reviews(spark, sf), "review_id", 500).select(
        "review_id", "product")


@query
def top_products(spark, sf):
    return analytics.product_catalog(ad.relational_reviews(spark, sf)).limit(10)


@query
def recent_predictions(spark, sf):
    log = ad.table(spark, sf, "events").select(
        F.concat(F.lit("rev_"), F.col("event_id")).alias("review_id"),
        F.col("ts").alias("timestamp"),
        F.repeat(F.concat("event_type", F.lit(" ")), F.lit(12)).alias("text"))
    return filters.recent_predictions(log).select("review_id", "snippet")


# ---------------------------------------------------------------- scalar functions
def _docs(spark, sf, **columns) -> DataFrame:
    return ad.table(spark, sf, "documents").select(
        "doc_id", *[c.alias(n) for n, c in columns.items()])


@query
def clean_text(spark, sf):
    return _docs(spark, sf, clean_text=tx.clean_text(F.col("text")))


@query
def strip_html(spark, sf):
    return ad.table(spark, sf, "pages").select(
        "page_id", tx.strip_html(tx.lower_text(F.col("html"))).alias("plain"))


@query
def strip_urls(spark, sf):
    return ad.table(spark, sf, "pages").select(
        "page_id", tx.strip_urls(tx.lower_text(F.col("html"))).alias("plain"))


@query
def expand_contractions(spark, sf):
    t = ad.text_table(ad.table(spark, sf, "documents"))
    return t.select("row_order", tx.expand_contractions(tx.lower_text(F.col("text"))).alias("spelled"))


@query
def normalise_letters(spark, sf):
    return _docs(spark, sf, letters=tx.normalise_letters(tx.lower_text(F.col("text"))))


@query
def review_id_hash(spark, sf):
    c = ad.table(spark, sf, "conversations")
    place = F.concat(F.lit("place_"), F.col("conv_id"))
    return c.select("conv_id", "turn",
                    tx.review_id(F.col("role"), F.col("conv_id"), F.col("turn"), F.col("text"))
                    .alias("review_id"),
                    tx.place_review_id(place, F.col("role"), F.col("text")).alias("place_review_id"))


@query
def epoch_ms_to_utc(spark, sf):
    e = ad.table(spark, sf, "events")
    ms = F.when(F.col("event_type") == "error", 0).when(
        F.col("event_type") != "view", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.select("event_id", tx.epoch_ms_to_utc(ms).alias("date"))


def _intelligence(spark, sf) -> DataFrame:
    return rules.with_intelligence(ad.text_reviews(spark, sf))


@query
def aspect_tags(spark, sf):
    return _intelligence(spark, sf).select(
        "row_order", F.array_join("all_aspects", "|").alias("all_aspects"), "primary_aspect")


@query
def issue_detect(spark, sf):
    return _intelligence(spark, sf).select("row_order", "issue")


@query
def priority_rule(spark, sf):
    return _intelligence(spark, sf).select("row_order", "priority")


@query
def suggested_action(spark, sf):
    return _intelligence(spark, sf).select("row_order", "suggested_action")


@query
def review_intelligence(spark, sf):
    return _intelligence(spark, sf).select(
        "row_order", "sentiment", "rating", "primary_aspect",
        F.array_join("all_aspects", "|").alias("all_aspects"), "issue", "priority",
        "suggested_action")


@query
def star_label(spark, sf):
    li = ad.table(spark, sf, "lineitem").select((F.col("l_quantity") / 8 - 0.5).alias("rating"))
    return (li.groupBy("rating").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("stars", labels.star_label(F.col("rating"))))


@query
def review_snippet(spark, sf):
    t = F.col("text")
    return _docs(spark, sf, card=tx.snippet(t), history=tx.snippet(t, 70, "..."),
                 mismatch=tx.snippet(t, always=True))


@query
def date_coverage(spark, sf):
    return analytics.date_coverage(analytics.product_kpis(ad.relational_reviews(spark, sf)))


@query
def product_narrative(spark, sf):
    t = ad.text_reviews(spark, sf)
    return analytics.product_narrative(analytics.product_kpis(t), analytics.product_complaints(t))


@query
def explain_tokenise(spark, sf):
    tokens = tx.attribution_tokens(F.col("text"))
    return _docs(spark, sf, n_tokens=F.size(tokens), joined=F.array_join(tokens, "¦"))


@query
def ngram_counts(spark, sf):
    return vectorise.ngram_counts(clean_text(spark, sf))


@query
def html_escape(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", tx.html_escape(F.col("html")).alias("safe"))


@query
def token_count(spark, sf):
    return _docs(spark, sf, tokens=tx.token_count(F.col("text")))


@query
def label_normalise(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    raw = ad.pick(ad.RAW_LABELS, F.col("l_linenumber") - 1)
    return (li.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("label", labels.normalise_label(F.col("raw"))))


# ---------------------------------------------------------------- learning and scoring
@query
def tfidf_table(spark, sf):
    table = vectorise.tfidf_table(clean_text(spark, sf), "doc_id")
    return table.withColumn("tfidf", F.round("tfidf", 6))


@query
def model_routing(spark, sf):
    return (ad.relational_reviews(spark, sf).groupBy("model_requested")
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("model_used", labels.route_model(F.col("model_requested"))))


@query
def explain_tokens(spark, sf):
    docs = ad.table(spark, sf, "documents").select("doc_id", "text")
    coefs = _coefficients(spark, sf)
    return _pct(attribution.explain_tokens(docs, coefs, "doc_id"), "diff")


@query
def explain_top_words(spark, sf):
    docs = ad.table(spark, sf, "documents").select("doc_id", "text")
    tokens = attribution.explain_tokens(docs, _coefficients(spark, sf), "doc_id")
    return _pct(attribution.top_words(tokens.withColumn("diff", F.round("diff", 6)), "doc_id"),
                "score")


@query
def cosine_topk(spark, sf):
    return keyphrases.cosine_topk(ad.table(spark, sf, "embeddings"), "label", "vec_id", "embedding",
                                  64, 10)


@query
def mmr_select(spark, sf):
    near = keyphrases.similarity_to_centre(ad.table(spark, sf, "embeddings"), "label", "embedding",
                                           64)
    return keyphrases.mmr_select(near, "label", "vec_id", "embedding", 5)


@query
def keyphrases_by_sentiment(spark, sf):
    prepared = etl.preprocess(ad.labelled_texts(spark, sf), "row_order")
    return keyphrases.keyphrases_by_sentiment(materialise(prepared, "prepared"), 5)


@lru_cache(maxsize=None)
def _split_of(app: str, sf: str) -> DataFrame:
    spark = SparkSession.getActiveSession()
    rows = ad.text_reviews(spark, sf).select(
        "row_order", "review_id", "title", "product", "rating", "helpful_votes",
        "verified_purchase", "date", "sentiment", "text")
    return materialise(pipelines.prepare_training(rows), "split")


@lru_cache(maxsize=None)
def _features_of(app: str, sf: str):
    return pipelines.featurise(_split_of(app, sf))


@lru_cache(maxsize=None)
def _fitted(app: str, sf: str, name: str):
    return pipelines.fit(name, _features_of(app, sf)[1])


def _split(spark, sf) -> DataFrame:
    return _split_of(spark.sparkContext.applicationId, sf)


def _artifacts(spark, sf, *names: str) -> models.Artifacts:
    app = spark.sparkContext.applicationId
    return models.Artifacts(_features_of(app, sf)[0], {n: _fitted(app, sf, n) for n in names})


def _evaluated(spark, sf, name: str) -> DataFrame:
    test = _split(spark, sf).filter("is_test")
    return models.evaluate_models(test, _artifacts(spark, sf, name)).drop(
        "confusion_matrix", "labels")


@query
def train_lr(spark, sf):
    return _evaluated(spark, sf, "logistic_regression")


@query
def train_balanced_lr(spark, sf):
    return _evaluated(spark, sf, "balanced_logistic_regression")


@query
def train_linear_svc(spark, sf):
    return _evaluated(spark, sf, "linearsvc")


@query
def evaluate_models(spark, sf):
    test = _split(spark, sf).filter("is_test")
    return models.evaluate_models(test, _artifacts(spark, sf, *labels.MODELS))


@query
def score_reviews(spark, sf):
    fresh = ad.text_table(ad.table(spark, sf, "documents")).select("review_id", "text", "rating")
    return readers.with_mismatch(models.score(fresh, _artifacts(spark, sf, labels.DEFAULT_MODEL)))


@query
def class_keywords_fitted(spark, sf):
    name = "logistic_regression"
    docs = ad.table(spark, sf, "documents")
    return models.class_keywords(
        models.coefficient_table(_artifacts(spark, sf, name), name, docs), 20)


@query
def heldout_report(spark, sf):
    return models.held_out_report(_split(spark, sf), _artifacts(spark, sf, labels.DEFAULT_MODEL))


def _stub_scorer():
    """Stand-in for an external classifier: scores by length, no answer for odd lengths."""
    def predict(texts: np.ndarray) -> np.ndarray:
        n = np.array([len(t) for t in texts], dtype="float64")
        scores = np.stack([n % 5, n % 3, n % 7], axis=1) + 1.0
        scores /= scores.sum(axis=1, keepdims=True)
        scores[n % 2 == 1] = np.nan
        return scores
    return predict


@query
def external_scorer_fallback(spark, sf):
    fresh = ad.text_table(ad.table(spark, sf, "documents")).select("review_id", "text")
    return models.score_external(fresh, _artifacts(spark, sf, labels.DEFAULT_MODEL), _stub_scorer)


@query
def place_analysis(spark, sf):
    """Scored reviews, each beside its place and the pulse of that."""
    artifacts = _artifacts(spark, sf, labels.DEFAULT_MODEL)
    scored, places = pipelines.analyse_places(
        ad.place_payloads(spark, sf), lambda r: materialise(models.score(r, artifacts), "scored-places"))
    return pipelines.place_reports(scored, places)


# The same with stored models, whose coefficients SQL can compute too.
def _stored_models(spark, sf) -> linear.LinearModels:
    path = work_dir(spark, "linear-models")
    linear.save(ad.stand_in_models(spark, sf), path)
    return linear.load(spark, path)


@query
def score_stored(spark, sf):
    fresh = ad.text_table(ad.table(spark, sf, "documents")).select("review_id", "text", "rating")
    return readers.with_mismatch(linear.score(fresh, "review_id", _stored_models(spark, sf))).drop("text")


@query
def score_routed(spark, sf):
    """Each review by the model that its request names, all in one pass."""
    fresh = ad.text_table(ad.table(spark, sf, "documents")).select(
        "review_id", "text", ad.pick(ad.MODEL_REQUESTS, F.col("row_order") % 7).alias("model_requested"))
    return linear.score_routed(fresh, "review_id", _stored_models(spark, sf)).drop("text", "clean_text")


@query
def evaluate_stored(spark, sf):
    prepared = etl.preprocess(ad.labelled_texts(spark, sf), "row_order")
    return linear.evaluate(prepared, "review_id", _stored_models(spark, sf)).select(
        "model_name", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query
def place_analysis_stored(spark, sf):
    stored = _stored_models(spark, sf)
    return pipelines.analyse_places(
        ad.place_payloads(spark, sf), lambda r: linear.score(r, "review_id", stored))[0].drop("text")


@query
def place_overview(spark, sf):
    stored = _stored_models(spark, sf)
    return pipelines.analyse_places(
        ad.place_payloads(spark, sf), lambda r: linear.score(r, "review_id", stored))[1]


@query
def etl_pipeline(spark, sf):
    return pipelines.run_etl(ad.raw_reviews(spark, sf))


@query
def train_pipeline(spark, sf):
    rows = ad.text_reviews(spark, sf).select("row_order", "review_id", "sentiment", "text")
    return pipelines.train_and_evaluate(rows)[1]


# ---------------------------------------------------------------- streams
def _stream(spark, sf, name: str) -> DataFrame:
    """A table, which is one file or a folder of files, as a stream.

    The brackets make the path a glob: a path without one would have to be a folder.
    """
    schema = ad.table(spark, sf, name).schema
    return live.file_stream(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", schema, "*")


@query
def stream_score(spark, sf):
    """Arriving reviews scored by the stored models and tagged by the label they got."""
    stored = _stored_models(spark, sf)
    columns = ["row_order", "sentiment", "confidence", "model_used", "primary_aspect",
               F.array_join("all_aspects", "|").alias("all_aspects"), "issue", "priority", "suggested_action"]

    def each(batch: DataFrame) -> DataFrame:
        return rules.with_intelligence(linear.score(readers.spread(batch), "review_id", stored)).select(*columns)

    folder = work_dir(spark, "stream-score")
    live.append_batches(ad.text_table(_stream(spark, sf, "documents")), f"{folder}/rows", f"{folder}/state",
                        each).awaitTermination()
    schema = ("row_order long, sentiment string, confidence double, model_used string, primary_aspect string, "
              "all_aspects string, issue string, priority string, suggested_action string, batch long")
    return spark.read.schema(schema).parquet(f"{folder}/rows").drop("batch")


@query
def stream_log_dedup(spark, sf):
    twice = _stream(spark, sf, "events").unionByName(_stream(spark, sf, "events"))
    once = live.dedup_log_stream(ad.event_log(twice)).select("review_id", "sentiment")
    folder = work_dir(spark, "stream-dedup")
    live.append_to(once, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/rows")


@query
def stream_windowed_ratio(spark, sf):
    ratio = live.windowed_ratio_stream(ad.event_log(_stream(spark, sf, "events"))).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd"))
    folder = work_dir(spark, "stream-ratio")

    live.update_windows(ratio, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return live.latest_windows(spark, f"{folder}/rows", ratio.schema)
