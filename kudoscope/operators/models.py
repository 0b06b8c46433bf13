"""Linear sentiment models: training, scoring, evaluation, coefficients."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kudoscope.functions import labels, text as tx
from kudoscope.functions.labels import DEFAULT_MODEL, EXTERNAL_MODEL, MODELS
from kudoscope.operators import evaluation, margin
from kudoscope.operators.ranking import top_per_group
from kudoscope.operators.splitting import stratified_sample
from kudoscope.operators.vectorise import vocabulary_of
from kudoscope.schemas import LABELS

# Provenance of the held-out report. Convergence tolerance.
HELD_OUT_SOURCE = "amazon_reviews_2023_test_split"
TOLERANCE = 1e-4
# Rows are packed into blocks of this size for each pass of a fit.
BLOCK_MB = 16.0


@dataclass
class Artifacts:
    """A fitted vectoriser and one fitted classifier pipeline per model code."""
    vectoriser: PipelineModel
    classifiers: dict[str, PipelineModel]


def _label_index(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in LABELS]), label) - 1).cast("double")


def _logistic(train: DataFrame, n: int, weights: DataFrame | None, max_iter: int) -> PipelineModel:
    # objective C * sum(loss) + |w|^2 / 2 with C = 1 equals mean loss + (1/n) |w|^2 / 2
    lr = LogisticRegression(featuresCol="features", labelCol="label_index", family="multinomial",
                            regParam=1.0 / n, standardization=False, maxIter=max_iter,
                            tol=TOLERANCE, maxBlockSizeInMB=BLOCK_MB)
    if weights is not None:
        # one row per class
        train = train.join(F.broadcast(weights.select("sentiment", "weight")), "sentiment")
        lr = lr.setWeightCol("weight")
    return PipelineModel([lr.fit(train)])


def weights_of(classifier: PipelineModel) -> list:
    """Coefficients per class, in the order of LABELS, without the intercepts."""
    first = classifier.stages[0]
    if isinstance(first, LogisticRegressionModel):
        return list(first.coefficientMatrix.toArray())
    return [s.coefficients.toArray() for s in classifier.stages]


def intercepts_of(classifier: PipelineModel) -> list[float]:
    first = classifier.stages[0]
    if isinstance(first, LogisticRegressionModel):
        return list(first.interceptVector.toArray())
    return [s.intercept for s in classifier.stages]


def fit_classifier(name: str, featured: DataFrame, max_iter: int = 1000,
                   svc_max_passes: int = 2000) -> PipelineModel:
    """Fit one of the three model codes on rows with ``features`` and ``sentiment``.

    All fits stop on tolerance, long before their limits.
    """
    if name == "linearsvc":
        return PipelineModel(margin.fit(featured, svc_max_passes))
    train = featured.withColumn("label_index", _label_index(F.col("sentiment")))
    n = train.count()
    if name == "logistic_regression":
        return _logistic(train, n, None, max_iter)
    if name == "balanced_logistic_regression":
        return _logistic(train, n, evaluation.class_weights(featured), max_iter)
    raise ValueError(f"unknown model {name!r}")


def _classified(df: DataFrame, classifier: PipelineModel) -> DataFrame:
    """Add ``_label`` and ``_confidence`` to rows with ``features``; JVM only."""
    keep = df.columns
    out = classifier.transform(df)
    names = F.array(*[F.lit(c) for c in LABELS])
    if isinstance(classifier.stages[0], LogisticRegressionModel):
        probability = vector_to_array("probability")
        label = F.element_at(names, F.col("prediction").cast("int") + 1)
        return out.select(*keep, label.alias("_label"),
                          F.round(F.array_max(probability), 4).alias("_confidence"))
    margins = F.array(*[vector_to_array(f"margin_{c}")[1] for c in LABELS])
    label = F.element_at(names, F.array_position(margins, F.array_max(margins)).cast("int"))
    return out.select(*keep, label.alias("_label"), F.lit(None).cast("double").alias("_confidence"))


def score(df: DataFrame, artifacts: Artifacts, model: str = DEFAULT_MODEL,
          text_col: str | None = "text") -> DataFrame:
    """Add ``clean_text, sentiment, confidence, model_used``.

    ``text_col=None`` scores an existing ``clean_text``. Text that cleans to nothing
    is neutral without confidence. A narrow transformation, valid on streams.
    """
    model = model if model in artifacts.classifiers else DEFAULT_MODEL
    if text_col:
        df = df.withColumn("clean_text", tx.clean_text(F.col(text_col)))
    out = _classified(artifacts.vectoriser.transform(df), artifacts.classifiers[model])
    empty = F.col("clean_text") == ""
    return out.withColumns({
        "sentiment": F.when(empty, "neutral").otherwise(F.col("_label")),
        "confidence": F.when(~empty, F.col("_confidence")),
        "model_used": F.lit(model),
    }).drop("features", "_label", "_confidence")


def score_routed(df: DataFrame, artifacts: Artifacts, requested: str = "model_requested",
                 text_col: str = "text") -> DataFrame:
    """Score each row by the model its request resolves to; one branch per model."""
    routed = df.withColumn("_route", labels.route_model(F.col(requested)))
    out = None
    for name in MODELS:
        mine = F.col("_route") == name
        if name == DEFAULT_MODEL:           # also stands in for the external scorer
            mine = mine | (F.col("_route") == EXTERNAL_MODEL)
        part = score(routed.filter(mine), artifacts, name, text_col)
        out = part if out is None else out.unionByName(part)
    return out.drop("_route")


def external_scores(df: DataFrame, make_predict_fn: Callable, text_col: str = "text",
                    batch_size: int = 64, max_chars: int | None = None,
                    threshold: float | None = None) -> DataFrame:
    """Add ``external_label, external_confidence`` of a user-supplied batch scorer.

    ``make_predict_fn`` is built once per Python worker and maps an array of texts
    to rows of (negative, neutral, positive) scores; a row of NaN means it failed.
    ``max_chars`` serves scorers with a bounded input; ``threshold`` discards weak
    answers. Discarded and failed rows stay null for a fallback.
    """
    scorer = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                               batch_size=batch_size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    best = F.array_max(F.filter(F.col("_scores"), lambda s: ~F.isnan(s)))
    label = F.element_at(F.array(*[F.lit(c) for c in LABELS]),
                         F.array_position("_scores", best).cast("int"))
    kept = best.isNotNull()
    if threshold is not None:
        kept = kept & (best >= threshold)
    return df.withColumn("_scores", scorer(text)).withColumns({
        "external_label": F.when(kept, labels.normalise_label(label)),
        "external_confidence": F.when(kept, F.round(best, 4)),
    }).drop("_scores")


def score_external(df: DataFrame, artifacts: Artifacts, make_predict_fn: Callable,
                   text_col: str = "text", **options) -> DataFrame:
    """External scorer first, default model where it gave no answer; logs who scored."""
    scored = score(df, artifacts, DEFAULT_MODEL, text_col)
    both = external_scores(scored, make_predict_fn, text_col, **options)
    blank = tx.is_blank(F.col(text_col)) | (F.col("clean_text") == "")
    used = F.col("external_label").isNotNull() & ~blank
    return both.withColumns({
        "sentiment": F.when(used, F.col("external_label")).otherwise(F.col("sentiment")),
        "confidence": F.when(used, F.col("external_confidence")).otherwise(F.col("confidence")),
        "model_used": F.when(used, EXTERNAL_MODEL).otherwise(F.col("model_used")),
        "model_requested": F.lit(EXTERNAL_MODEL),
    }).drop("external_label", "external_confidence")


def coefficient_table(artifacts: Artifacts, model: str, df: DataFrame) -> DataFrame:
    """``(class, term, coef)`` of a fitted model: classes x vocabulary rows, hence bounded."""
    spark = df.sparkSession
    terms = vocabulary_of(artifacts.vectoriser)
    matrix = weights_of(artifacts.classifiers[model])
    rows = [(c, t, float(w)) for c, line in zip(LABELS, matrix) for t, w in zip(terms, line)]
    return spark.createDataFrame(rows, "class string, term string, coef double")


def class_keywords(coefs: DataFrame, top_n: int = 10) -> DataFrame:
    """Top coefficients per class. ``position`` lists them ascending, ``score`` is 1."""
    top = top_per_group(coefs, ["class"], [F.col("coef").desc()], top_n, "term")
    n = F.count(F.lit(1)).over(Window.partitionBy("class"))
    return top.select("class", "term", "coef", "rank",
                      (n - F.col("rank") + 1).cast("int").alias("position"),
                      F.lit(1.0).alias("score"))


def held_out_report(split: DataFrame, artifacts: Artifacts, n: int = 200,
                    model: str = DEFAULT_MODEL) -> DataFrame:
    """Stratified sample of the test rows, scored, label beside prediction."""
    sample = stratified_sample(split.filter("is_test"), n)
    sample = sample.withColumn("label_sentiment", F.col("sentiment"))
    scored = score(sample, artifacts, model, text_col=None)
    return scored.select(
        "review_id", "text", "title", "rating", "product", "date", "helpful_votes",
        "verified_purchase", "label_sentiment", "sentiment", "confidence",
        F.col("model_used").alias("model_name"), F.lit(HELD_OUT_SOURCE).alias("source"),
        labels.is_mismatch(F.col("rating"), F.col("sentiment")).alias("is_mismatch"),
        "clean_text")


def evaluate_models(test: DataFrame, artifacts: Artifacts) -> DataFrame:
    """One evaluation record per fitted model over the same test rows."""
    featured = artifacts.vectoriser.transform(test.select("clean_text", "sentiment"))
    scored = None
    for name, classifier in artifacts.classifiers.items():
        part = _classified(featured, classifier).select(
            F.lit(name).alias("model_name"), F.col("sentiment").alias("actual"),
            F.col("_label").alias("predicted"))
        scored = part if scored is None else scored.unionByName(part)
    return evaluation.evaluation_records(scored)
