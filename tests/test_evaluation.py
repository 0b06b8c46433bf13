"""Evaluation arithmetic against published confusion matrices."""

import pytest
from conftest import rows

from kudoscope.operators import evaluation as ev
from kudoscope.schemas import LABELS

# model -> (matrix rows actual negative, neutral, positive; published metrics)
PUBLISHED = {
    "logistic_regression": (
        ((2774, 116, 644), (471, 155, 749), (332, 135, 10960)),
        dict(accuracy=0.850208, macro_precision=0.681506, macro_recall=0.618935,
             macro_f1=0.625347, weighted_f1=0.828218)),
    "balanced_logistic_regression": (
        ((2674, 673, 187), (383, 724, 268), (572, 1233, 9622)),
        dict(accuracy=0.797013, macro_precision=0.655658, macro_recall=0.708412,
             macro_f1=0.667689, weighted_f1=0.817931)),
    "linearsvc": (
        ((2775, 162, 597), (496, 190, 689), (386, 175, 10866)),
        dict(accuracy=0.846658, macro_precision=0.671175, macro_recall=0.624772,
             macro_f1=0.631085, weighted_f1=0.828486)),
}


@pytest.fixture(scope="module")
def judged(spark):
    cells = [(m, a, p, n) for m, (matrix, _) in PUBLISHED.items()
             for a, line in zip(LABELS, matrix) for p, n in zip(LABELS, line)]
    df = spark.createDataFrame(cells, "model_name string, actual string, predicted string, n int")
    return df.selectExpr("model_name", "actual", "predicted", "explode(sequence(1, n)) AS i").drop("i")


def test_published_metrics(judged):
    records = {r["model_name"]: r for r in ev.evaluation_records(judged).collect()}
    for model, (matrix, metrics) in PUBLISHED.items():
        r = records[model]
        assert [tuple(line) for line in r["confusion_matrix"]] == list(matrix)
        assert {k: r[k] for k in metrics} == metrics
        assert list(r["labels"]) == list(LABELS) and r["precision"] == r["macro_precision"]


def test_published_recall(judged):
    report = ev.classification_report(ev.confusion_cells(judged, keys=["model_name"]), ["model_name"])
    recall = {(r["model_name"], r["label"]): r["recall"] for r in report.collect()}
    assert recall["logistic_regression", "neutral"] == 0.112727
    assert recall["balanced_logistic_regression", "neutral"] == 0.526545
    assert recall["linearsvc", "positive"] == 0.950906


def test_absent_class_and_zero_division(spark):
    df = spark.createDataFrame([("negative", "negative"), ("positive", "negative")],
                               "actual string, predicted string")
    cells = ev.confusion_cells(df)
    assert ev.confusion_matrix(cells).count() == 9
    m = ev.classification_metrics(cells).first()
    # neutral occurs nowhere, so it does not enter the macro mean; positive has precision 0
    assert m["accuracy"] == 0.5 and m["macro_precision"] == 0.25 and m["macro_recall"] == 0.5


def test_class_weights(spark):
    df = spark.createDataFrame([("negative",)] * 2 + [("positive",)] * 6 + [(None,)], "sentiment string")
    assert rows(ev.class_weights(df)) == [("negative", 2, 2.0), ("positive", 6, 8 / 12)]


def test_model_comparison_falls_back(spark):
    df = spark.createDataFrame(
        [("linearsvc", 0.846658, 0.6, 0.7, 0.63, None, None, None, None, 0.000122)],
        "model_name string, accuracy double, precision double, recall double, f1 double, "
        "macro_precision double, macro_recall double, macro_f1 double, weighted_f1 double, "
        "latency double")
    assert rows(ev.model_comparison(df)) == [
        ("LinearSVC", "84.67%", "70.00%", "60.00%", "0.6300", "0.0000", "0.0001 ms/sample")]
