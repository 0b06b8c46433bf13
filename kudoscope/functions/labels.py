"""Small value rules: labels, flags, display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kudoscope.schemas import LABELS

# ---------------------------------------------------------------- fixed values
MODELS = ("logistic_regression", "balanced_logistic_regression", "linearsvc")
DEFAULT_MODEL = "balanced_logistic_regression"
EXTERNAL_MODEL = "distilbert"
MODEL_NAMES = {
    "logistic_regression": "Standard Logistic Regression",
    "balanced_logistic_regression": "Balanced Logistic Regression",
    "linearsvc": "LinearSVC",
}
SCORER_LABELS = {
    "positive": "positive", "neutral": "neutral", "negative": "negative",
    "label_0": "negative", "label_1": "neutral", "label_2": "positive",
}
# ------------------------------------------------------------ end fixed values


def rating_to_sentiment(rating: Column) -> Column:
    """1-2 negative, 3 neutral, 4-5 positive; anything else, also unparseable, null."""
    stars = rating.try_cast("double")
    return (F.when(stars.between(1, 2), "negative")
            .when(stars == 3, "neutral")
            .when(stars.between(4, 5), "positive"))


def is_mismatch(rating: Column, sentiment: Column) -> Column:
    """Stars and text disagree: four or more with negative text, two or less with positive."""
    return F.coalesce(over_rated(rating, sentiment) | under_rated(rating, sentiment), F.lit(False))


def over_rated(rating: Column, sentiment: Column) -> Column:
    return (rating >= 4) & (sentiment == "negative")


def under_rated(rating: Column, sentiment: Column) -> Column:
    return (rating <= 2) & (sentiment == "positive")


def star_label(rating: Column) -> Column:
    """``★★★☆☆ 3/5``; ties round to even, clamped to 1-5, unreadable is 5."""
    stars = F.coalesce(F.bround(rating.try_cast("double"), 0), F.lit(5.0)).cast("int")
    stars = F.greatest(F.lit(1), F.least(F.lit(5), stars))
    return F.concat(F.repeat(F.lit("★"), stars), F.repeat(F.lit("☆"), F.lit(5) - stars),
                    F.lit(" "), stars.cast("string"), F.lit("/5"))


def normalise_label(label: Column) -> Column:
    """Class name of an external scorer's label, whatever its case; unknown passes through."""
    low = F.lower(label)
    out = low
    for raw, name in SCORER_LABELS.items():
        out = F.when(low == raw, F.lit(name)).otherwise(out)
    return out


def resolve_model(kind: str, model: str | None = None, model_name: str | None = None) -> str:
    """The model a request means: single and batch requests prefer different fields."""
    if kind == "single":
        return model or model_name or "linearsvc"
    if kind == "batch":
        return model_name or model or DEFAULT_MODEL
    raise ValueError(f"unknown request kind {kind!r}")


def route_model(requested: Column) -> Column:
    """A known model as asked; the external scorer in any case; else the default."""
    return (F.when(requested.isin(*MODELS), requested)
            .when(F.lower(requested) == EXTERNAL_MODEL, F.lit(EXTERNAL_MODEL))
            .otherwise(F.lit(DEFAULT_MODEL)))


def model_display_name(model: Column) -> Column:
    out = model
    for code, name in MODEL_NAMES.items():
        out = F.when(model == code, F.lit(name)).otherwise(out)
    return out


def share_pct(part: Column, whole: Column) -> Column:
    """Unrounded percentage; an empty whole gives 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def class_counts(sentiment: Column) -> list[Column]:
    """One conditional count per class, named by class: a single pass, no join."""
    return [F.count_if(sentiment == label).alias(label) for label in LABELS]
