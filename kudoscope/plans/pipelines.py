"""The end-to-end pipelines, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from kudoscope.functions.labels import DEFAULT_MODEL, MODELS
from kudoscope.operators import analytics, etl, models, splitting
from kudoscope.operators.vectorise import fit_transform
from kudoscope.schemas import LABELS, RAW_REVIEW
from kudoscope.session import materialise
from kudoscope.sources import readers

# Numbers of a pulse; a place without reviews has zeros.
PULSE = ["total_reviews", *[f"{c}_{what}" for c in LABELS for what in ("count", "pct")], "mismatch_count", "mismatch_pct"]


def run_etl(raw: DataFrame, target: int | None = None, total_rows: int | None = None,
            order: str = "row_order") -> DataFrame:
    """Raw records -> sampled, labelled, cleaned, deduplicated review table."""
    if target is not None:
        total = raw.count() if total_rows is None else total_rows
        key = F.concat_ws("_", "user_id", "asin", "timestamp", "text")
        raw = etl.bernoulli_sample(raw, key, etl.sample_rate(total, target))
    return etl.processed_reviews(raw, order)


def line_funnel(lines: DataFrame, rate: float = 1.0, column: str = "value") -> DataFrame:
    """Counters of the ETL from the lines of a JSON-lines source, blank and broken ones included.

    With a ``rate`` below 1 a line is drawn by its content, before it is parsed: equal
    lines are drawn together, and lines that are not drawn are counted but not parsed.
    """
    line = F.coalesce(F.col(column), F.lit(""))
    drawn = etl.below_rate(etl.draw_hash(line, etl.SEED), rate)
    picked = lines.select(F.when(drawn, line).alias("_line"), drawn.alias("drawn"))
    return etl.source_funnel(readers.decode_json(picked, "_line", RAW_REVIEW).drop("_line"))


def prepare_training(df: DataFrame, order: str = "row_order") -> DataFrame:
    """Prepared reviews with ``is_test``. Written once: the split and every fit read it."""
    prepared = etl.preprocess(etl.normalise_legacy(df), order)
    return splitting.stratified_split(materialise(prepared, "prepared"))


def featurise(split: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Vectoriser fitted on the training rows, and their features from a written table."""
    return fit_transform(split.filter("NOT is_test"), "review_id", "sentiment")


def fit(name: str, featured: DataFrame) -> PipelineModel:
    """Fit one model. Its iterations pass over the features many times, and every fit keeps
    them in blocks of its own: kept here too, they would be in memory twice."""
    return models.fit_classifier(name, featured)


def train(split: DataFrame, names: tuple[str, ...] = MODELS) -> models.Artifacts:
    """Fit the vectoriser and the classifiers on the training rows."""
    vectoriser, featured = featurise(split)
    return models.Artifacts(vectoriser, {n: fit(n, featured) for n in names})


def train_and_evaluate(df: DataFrame, order: str = "row_order") -> tuple[models.Artifacts, DataFrame]:
    """Whole training run; raises when a test text also occurs in training."""
    split = prepare_training(df, order)
    overlap = splitting.split_leakage(split).first()["overlap"]
    if overlap:
        raise ValueError(f"{overlap} texts occur in both training and test")
    artifacts = train(split)
    return artifacts, models.evaluate_models(split.filter("is_test"), artifacts)


def analyse_places(payloads: DataFrame, scorer: models.Artifacts | Callable[[DataFrame], DataFrame],
                   model: str = DEFAULT_MODEL, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Details payloads -> (scored unified reviews, pulse per place with what is known of it).

    ``scorer`` is a set of fitted models, of which ``model`` scores, or a function that adds
    ``clean_text, sentiment, confidence, model_used``. Of payloads of one place that differ,
    the greatest rating, address, link and number of ratings hold.
    """
    def score(reviews: DataFrame) -> DataFrame:
        return models.score(reviews, scorer, model) if isinstance(scorer, models.Artifacts) else scorer(reviews)

    places = readers.place_details(payloads, body)
    scored = readers.with_mismatch(score(readers.unified_place_reviews(places)).drop("model_used"))
    known = places.groupBy("place_id").agg(
        F.max("name").alias("name"), F.max("address").alias("address"), F.max("rating").alias("overall_rating"),
        F.max("user_rating_count").alias("user_rating_count"), F.max("maps_uri").alias("maps_uri"))
    return scored, known.join(analytics.place_pulse(scored), "place_id", "left").na.fill(0, PULSE)


def place_reports(scored: DataFrame, places: DataFrame) -> DataFrame:
    """Both results of ``analyse_places`` as one: every review beside its place and the pulse of that.

    A place without reviews is one row without a review. Reviews of payloads without an id stay,
    and have no pulse, as they are of no one place.
    """
    pulse = places.withColumns({c: F.when(F.col("place_id").isNotNull(), F.col(c)) for c in PULSE})
    pulse = pulse.withColumnRenamed("place_id", "_place")
    # reviews on the outer side, where a place with very many of them can be split
    beside = scored.join(pulse, F.col("place_id").eqNullSafe(F.col("_place")), "left").drop("_place")
    seen = scored.select(F.col("place_id").alias("_seen")).distinct()
    bare = pulse.join(seen, F.col("_place").eqNullSafe(F.col("_seen")), "left_anti").withColumnRenamed("_place", "place_id")
    return beside.unionByName(bare, allowMissingColumns=True)
