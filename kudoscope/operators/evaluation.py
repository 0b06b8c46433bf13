"""Evaluation of predicted against actual labels, as arithmetic over one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kudoscope.functions import labels
from kudoscope.schemas import LABELS


def _cell(actual: str, predicted: str) -> Column:
    return F.col(f"{actual}__{predicted}")


def confusion_cells(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                    keys: list[str] | None = None) -> DataFrame:
    """One row per ``keys`` with the nine cell counts: a single hash aggregate."""
    return df.groupBy(*(keys or [])).agg(*[
        F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}__{p}")
        for a in LABELS for p in LABELS])


def confusion_matrix(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dense ``(actual, predicted, count)`` rows, absent pairs 0."""
    return cells.select(*(keys or []), F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), _cell(a, p).alias("count"))
        for a in LABELS for p in LABELS])))


def _sum(columns) -> Column:
    return sum(columns, F.lit(0).cast("bigint"))


def _ratio(a: Column, b: Column) -> Column:
    """Zero division counts as zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _per_class(label: str) -> dict[str, Column]:
    hits = _cell(label, label)
    support = _sum(_cell(label, p) for p in LABELS)
    claimed = _sum(_cell(a, label) for a in LABELS)
    precision, recall = _ratio(hits, claimed), _ratio(hits, support)
    return {"precision": precision, "recall": recall,
            "f1": _ratio(2 * hits, claimed + support), "support": support,
            "present": ((claimed + support) > 0).cast("int")}


def classification_report(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    return cells.select(*(keys or []), F.inline(F.array(*[
        F.struct(F.lit(c).alias("label"),
                 *[F.round(_per_class(c)[m], 6).alias(m) for m in ("precision", "recall", "f1")],
                 _per_class(c)["support"].alias("support")) for c in LABELS])))


def classification_metrics(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted precision, recall, F1, rounded to six digits.

    Macro averages run over the classes that occur as actual or predicted.
    """
    per = {c: _per_class(c) for c in LABELS}
    total = _sum(_cell(a, p) for a in LABELS for p in LABELS)
    present = sum((per[c]["present"] for c in LABELS), F.lit(0))

    def macro(metric: str) -> Column:
        return _ratio(sum((per[c][metric] for c in LABELS), F.lit(0.0)), present)

    def weighted(metric: str) -> Column:
        return _ratio(sum((per[c][metric] * per[c]["support"] for c in LABELS), F.lit(0.0)), total)

    values = {"accuracy": _ratio(_sum(_cell(c, c) for c in LABELS), total)}
    for name, average in (("macro", macro), ("weighted", weighted)):
        for metric in ("precision", "recall", "f1"):
            values[f"{name}_{metric}"] = average(metric)
    return cells.select(*(keys or []), *[F.round(v, 6).alias(n) for n, v in values.items()])


def evaluation_records(scored: DataFrame) -> DataFrame:
    """One record per ``model_name`` with metrics, nested matrix and label order."""
    matrix = F.array(*[F.array(*[_cell(a, p) for p in LABELS]) for a in LABELS])
    cells = confusion_cells(scored, keys=["model_name"]).withColumn("confusion_matrix", matrix)
    return (classification_metrics(cells, ["model_name", "confusion_matrix"])
            .withColumns({"precision": F.col("macro_precision"), "recall": F.col("macro_recall"),
                          "labels": F.array(*[F.lit(c) for c in LABELS])}))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight N / (K * n) of every class that occurs."""
    counts = df.agg(*labels.class_counts(F.col("sentiment")))
    rows = counts.select(
        _sum(F.col(c) for c in LABELS).alias("_n"),
        sum(((F.col(c) > 0).cast("int") for c in LABELS), F.lit(0)).alias("_k"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("count"))
                           for c in LABELS])))
    return (rows.filter(F.col("count") > 0)
            .select("sentiment", "count",
                    (F.col("_n").cast("double") / (F.col("_k") * F.col("count"))).alias("weight")))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Display table of stored metrics."""
    def pct(c: Column) -> Column:
        return F.format_string("%.2f%%", F.round(c * 100, 2))

    def score(c: Column) -> Column:
        return F.format_string("%.4f", F.round(c, 4))

    zero = F.lit(0.0)
    return metrics.select(
        labels.model_display_name(F.col("model_name")).alias("model"),
        pct(F.col("accuracy")).alias("accuracy"),
        pct(F.coalesce("macro_recall", "recall", zero)).alias("macro_recall"),
        pct(F.coalesce("macro_precision", "precision", zero)).alias("macro_precision"),
        score(F.coalesce("macro_f1", "f1", zero)).alias("macro_f1"),
        score(F.coalesce("weighted_f1", zero)).alias("weighted_f1"),
        F.concat(score(F.coalesce("latency", zero)), F.lit(" ms/sample")).alias("batch_latency"))
