"""Toxicity: the ordinal model itself, held-out accuracy, odd rows."""

import numpy as np
import pytest
from llm_cases import none, odd  # noqa: F401
from pyspark.sql import functions as F

from kudoscope.llm import toxicity

MID = "/root/testdata/sf0.1"


def test_weights_are_shared_and_thresholds_ascend():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)) < 0.4
    latent = x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.logistic(size=3000)
    y = (latent > 1.0).astype(int) + (latent > 3.0)
    row, col = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, col, y, 4, 3, ridge=0.01, steps=1500)
    assert np.allclose(w, [2, 1, 0, -1], atol=0.25) and np.allclose(theta, [1, 3], atol=0.25)

    def loss(w, theta):
        above = 1 / (1 + np.exp(-(x @ w)[:, None] + theta[None, :]))
        full = np.column_stack([np.ones(len(y)), above, np.zeros(len(y))])
        rows = np.arange(len(y))
        return -np.log(full[rows, y] - full[rows, y + 1]).sum() + 0.005 * (w ** 2).sum()

    for i in range(4):  # a stationary point of the stated objective
        step = np.eye(4)[i] * 1e-3
        assert abs(loss(w + step, theta) - loss(w - step, theta)) / 2e-3 < 1.0


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    return docs, labels


def test_held_out_labels(spark, halves):
    docs, labels = halves
    train = labels.filter("doc_id % 3 <> 0")
    model = toxicity.fit(docs, train)
    held = labels.filter("doc_id % 3 = 0").join(docs.select("doc_id", "text"), "doc_id")
    got = toxicity.score(held.withColumnRenamed("toxic", "mark"), model).select("mark", "toxic", "severity").collect()
    caught = [r.toxic for r in got if r.mark == 1]
    clean = [r.toxic for r in got if r.mark == 0]
    assert len(caught) > 100 and np.mean(caught) > 0.88 and np.mean(clean) < 0.01
    assert all(0 <= r.severity <= 2 for r in got)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 0, 1), (6, 1, 0), (7, 1, None), (None, 1, 1), (8, 1, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in toxicity.grades(labels).collect()} == {6: 2, 8: 0, 99: 1}
    model = toxicity.OrdinalModel({"single": (9.0, 9.0, 9.0)}, (1.0, 2.0))
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert got[7].toxic and got[7].grade == 2 and not got[1].toxic and got[1].severity == got[2].severity
    assert len(toxicity.score(odd, model).collect()) == odd.count()
    kept = toxicity.harmless(odd, labels)
    assert kept.columns == odd.columns
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.toxic for r in toxicity.score(odd, empty).collect())
    assert toxicity.score(none, model).collect() == []


def test_columns_that_clash_are_replaced(spark):
    frame = spark.createDataFrame([(1, "x", "mine", 3)], "doc_id long, text string, toxic string, grade int")
    model = toxicity.OrdinalModel({}, (1.0, 2.0))
    assert dict(toxicity.score(frame, model).dtypes)["toxic"] == "boolean"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.harmless(frame, labels).collect() == frame.collect()


def test_the_sample_is_bounded_and_stable(spark, halves):
    docs, labels = halves
    sample = toxicity.labelled_sample(docs, labels, rows=500)
    n = sample.count()
    assert 350 < n < 650 and n == toxicity.labelled_sample(docs.repartition(7), labels, rows=500).count()
    assert sample.agg(F.sum("grade")).first() == toxicity.labelled_sample(docs, labels, rows=500).agg(F.sum("grade")).first()
