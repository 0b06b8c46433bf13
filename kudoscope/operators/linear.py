"""Linear models as tables: one sparse product scores a text by all models at once.

A table holds one row per term with its idf and its coefficients in every model, so it
is as long as the vocabulary. Scoring joins the terms of the texts with it and adds up;
the classes of all models stand side by side in one array of margins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.functions.labels import DEFAULT_MODEL, EXTERNAL_MODEL
from kudoscope.operators import evaluation
from kudoscope.operators.attribution import surrogate
from kudoscope.operators.models import Artifacts, intercepts_of, weights_of
from kudoscope.operators.vectorise import document_terms, vocabulary_of
from kudoscope.schemas import LABELS

TERMS = "term string, idf double, coefs array<double>"
HEADS = "model string, place int, calibrated boolean, intercepts array<double>"


@dataclass(frozen=True)
class Head:
    """What a model has beside its coefficients; ``calibrated`` ones give probabilities."""
    model: str
    calibrated: bool
    intercepts: tuple[float, ...]


@dataclass(frozen=True)
class LinearModels:
    """``terms``: ``TERMS``, whose ``coefs`` list the classes of the first head, then those
    of the next. At most as many rows as the vocabulary, so it may be broadcast."""
    terms: DataFrame
    heads: tuple[Head, ...]


def of_artifacts(spark: SparkSession, artifacts: Artifacts) -> LinearModels:
    """The tables of fitted models."""
    idf = next(s for s in artifacts.vectoriser.stages if isinstance(s, ElementwiseProduct)).getScalingVec()
    lines, heads = [], []
    for name, fitted in artifacts.classifiers.items():
        lines += [list(map(float, line)) for line in weights_of(fitted)]
        calibrated = isinstance(fitted.stages[0], LogisticRegressionModel)
        heads.append(Head(name, calibrated, tuple(map(float, intercepts_of(fitted)))))
    rows = [(t, float(i), list(c)) for t, i, *c in zip(vocabulary_of(artifacts.vectoriser), idf, *lines)]
    return LinearModels(spark.createDataFrame(rows, TERMS), tuple(heads))


def save(models: LinearModels, path: str) -> None:
    spark = models.terms.sparkSession
    models.terms.write.mode("overwrite").parquet(f"{path}/terms")
    rows = [(h.model, i, h.calibrated, list(h.intercepts)) for i, h in enumerate(models.heads)]
    spark.createDataFrame(rows, HEADS).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")


def load(spark: SparkSession, path: str) -> LinearModels:
    """Stored tables; a few rows, one per model, come to the driver."""
    heads = spark.read.schema(HEADS).parquet(f"{path}/heads").orderBy("place").collect()
    return LinearModels(spark.read.schema(TERMS).parquet(f"{path}/terms"),
                        tuple(Head(h.model, h.calibrated, tuple(h.intercepts)) for h in heads))


def term_weights(df: DataFrame, doc: str, terms: DataFrame, clean: str = "clean_text") -> DataFrame:
    """``(doc, term, weight)``: tf times idf, not yet at unit length."""
    known = F.broadcast(terms.select("term", "idf"))
    return (document_terms(df, doc, clean).join(known, "term").groupBy(doc, "term", "idf")
            .agg(F.count(F.lit(1)).alias("tf")).select(doc, "term", (F.col("tf") * F.col("idf")).alias("weight")))


def margins(df: DataFrame, doc: str, models: LinearModels, clean: str = "clean_text") -> DataFrame:
    """``df`` with ``margins``: the classes of the first model, then those of the next.

    ``doc`` names texts: rows that share one have equal texts. A text without known terms
    has the intercepts.
    The texts are shuffled once by ``doc`` to fan out into terms, and the rows once to meet
    the sums; both aggregations keep that partitioning.
    """
    width = len(LABELS) * len(models.heads)
    coefs = F.broadcast(models.terms.select("term", "coefs"))
    sums = (term_weights(df, doc, models.terms, clean).join(coefs, "term").groupBy(doc)
            .agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"),
                 *[F.sum(F.col("weight") * F.get("coefs", F.lit(i))).alias(f"_s{i}") for i in range(width)]))
    flat = [b for h in models.heads for b in h.intercepts]
    added = [F.coalesce(F.col(f"_s{i}") / F.col("_length"), F.lit(0.0)) + F.lit(b) for i, b in enumerate(flat)]
    return df.join(sums, doc, "left").withColumn("margins", F.array(*added)).drop(
        "_length", *[f"_s{i}" for i in range(width)])


def _answer(head: Head, place: int) -> Column:
    """Label and confidence of one model; text that cleans to nothing is neutral without any."""
    own = F.slice("margins", place * len(LABELS) + 1, len(LABELS))
    best = F.array_max(own)
    names = F.array(*[F.lit(c) for c in LABELS])
    label = F.element_at(names, F.array_position(own, best).cast("int"))
    share = 1 / F.aggregate(own, F.lit(0.0), lambda a, m: a + F.exp(m - best))
    empty = F.col("_empty")
    confidence = F.when(~empty, F.round(share, 4)) if head.calibrated else F.lit(None).cast("double")
    return F.struct(F.lit(head.model).alias("model"), F.when(empty, "neutral").otherwise(label).alias("sentiment"),
                    confidence.alias("confidence"))


def answers(df: DataFrame, doc: str, models: LinearModels, text_col: str | None = "text") -> DataFrame:
    """Add ``clean_text`` and ``answers``: model, sentiment and confidence of every model."""
    if text_col:
        df = df.withColumn("clean_text", tx.clean_text(F.col(text_col)))
    empty = F.coalesce(F.col("clean_text") == "", F.lit(True))
    listed = F.array(*[_answer(h, i) for i, h in enumerate(models.heads)])
    return (margins(df, doc, models).withColumn("_empty", empty).withColumn("answers", listed)
            .drop("margins", "_empty"))


def _chosen(df: DataFrame, model: Column) -> DataFrame:
    """``sentiment, confidence, model_used`` of the answer by ``model``, else by the default."""
    def by(name: Column) -> Column:
        return F.get(F.filter("answers", lambda a: a["model"] == name), 0)

    picked = F.coalesce(by(model), by(F.lit(DEFAULT_MODEL)))
    return df.withColumns({"sentiment": picked["sentiment"], "confidence": picked["confidence"],
                           "model_used": picked["model"]}).drop("answers")


def score(df: DataFrame, doc: str, models: LinearModels, model: str = DEFAULT_MODEL,
          text_col: str | None = "text") -> DataFrame:
    """Add ``clean_text, sentiment, confidence, model_used``, as ``models.score`` does."""
    return _chosen(answers(df, doc, models, text_col), F.lit(model))


def score_routed(df: DataFrame, doc: str, models: LinearModels, requested: str = "model_requested",
                 text_col: str = "text") -> DataFrame:
    """Each row by the model its request resolves to, all rows in one pass.

    The external scorer is stood in for by the linear model that explains it.
    """
    route = labels.route_model(F.col(requested))
    linear = F.when(route == EXTERNAL_MODEL, surrogate(EXTERNAL_MODEL)).otherwise(route)
    return _chosen(answers(df, doc, models, text_col), linear)


def evaluate(test: DataFrame, doc: str, models: LinearModels) -> DataFrame:
    """One evaluation record per model over the same test rows, in one pass."""
    scored = answers(test.select(doc, "clean_text", F.col("sentiment").alias("actual")), doc, models, None)
    return evaluation.evaluation_records(scored.select("actual", F.inline("answers")).select(
        F.col("model").alias("model_name"), "actual", F.col("sentiment").alias("predicted")))


def optimality(train: DataFrame, doc: str, models: LinearModels, at: int, weights: DataFrame | None = None
               ) -> DataFrame:
    """``term, class, gradient`` of the mean loss of head ``at`` plus its penalty, per coefficient.

    ``train`` has ``doc, clean_text, sentiment``; ``weights`` the weight of each class. A
    calibrated model has the multinomial log loss; the others have, for each class against
    the rest, the squared hinge. The penalty is half the squared coefficients over the
    number of rows, that of C = 1. One aggregate over the terms of all texts.
    """
    head, n = models.heads[at], train.count()
    scored = margins(train.select(doc, "clean_text", "sentiment"), doc, models)
    own = F.slice("margins", at * len(LABELS) + 1, len(LABELS))
    best = F.array_max(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, m: a + F.exp(m - best))
    pulls = []
    for k, c in enumerate(LABELS):
        hit, margin = F.col("sentiment") == c, F.get(own, F.lit(k))
        if head.calibrated:
            pulls.append(F.exp(margin - best) / total - hit.cast("double"))
        else:
            side = F.when(hit, 1.0).otherwise(-1.0)
            pulls.append(-2 * side * F.greatest(F.lit(0.0), 1 - side * margin))
    if weights is not None:
        scored = scored.join(F.broadcast(weights.select("sentiment", F.col("weight").alias("_w"))), "sentiment")
        pulls = [p * F.col("_w") for p in pulls]
    pulled = scored.select(doc, F.array(*pulls).alias("pulls"))
    weighted = term_weights(train, doc, models.terms)
    length = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    sums = (weighted.join(length, doc).join(pulled, doc)
            .groupBy("term").agg(*[F.sum(F.col("weight") / F.col("length") * F.get("pulls", F.lit(k))).alias(c)
                                   for k, c in enumerate(LABELS)]))
    each = [F.struct(F.lit(c).alias("class"), ((F.coalesce(c, F.lit(0.0)) + F.get("coefs", F.lit(at * len(LABELS) + k)))
                                               / n).alias("gradient")) for k, c in enumerate(LABELS)]
    return models.terms.join(sums, "term", "left").select("term", F.inline(F.array(*each)))
