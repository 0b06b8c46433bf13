"""Linear models as tables: same answers as the fitted pipelines, optimal fits."""

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kudoscope.functions.labels import MODELS
from kudoscope.operators import linear, margin, models
from kudoscope.plans import adapters as ad, pipelines
from kudoscope.schemas import LABELS


@pytest.fixture(scope="module")
def trained(spark):
    texts = ad.text_reviews(spark, SF).select("row_order", "review_id", "sentiment", "text")
    split = pipelines.prepare_training(texts)
    artifacts = pipelines.train(split)
    return split, artifacts, linear.of_artifacts(spark, artifacts)


def near(a, b):
    return len(a) == len(b) and all(
        x[:-1] == y[:-1] and (x[-1] == y[-1] or abs(x[-1] - y[-1]) <= 1.01e-4) for x, y in zip(a, b))


def test_tables_answer_like_the_fitted_models(spark, trained, tmp_path):
    split, artifacts, tables = trained
    linear.save(tables, f"{tmp_path}/models")
    stored = linear.load(spark, f"{tmp_path}/models")
    assert stored.heads == tables.heads
    texts = ad.text_table(ad.table(spark, SF, "documents")).select("review_id", "text").unionByName(
        spark.createDataFrame([("blank", " "), ("null", None), ("unknown", "zzqx qqzx")], "review_id string, text string"))
    for name in [*MODELS, "no such model"]:
        want = models.score(texts, artifacts, name).select("review_id", "clean_text", "model_used", "sentiment", "confidence")
        got = linear.score(texts, "review_id", stored, name).select(*want.columns)
        assert near(rows(got), rows(want))
    test = split.filter("is_test")
    assert rows(linear.evaluate(test, "review_id", stored)) == rows(models.evaluate_models(test, artifacts))


def test_a_stream_is_scored_like_a_batch(spark, trained, tmp_path):
    """Saved artifacts and saved tables, loaded into a stream, over files that land one by one."""
    from kudoscope.functions.rules import with_intelligence
    from kudoscope.sources import sinks
    from kudoscope.streaming import live

    _, artifacts, tables = trained
    sinks.save_artifacts(artifacts, f"{tmp_path}/fitted")
    linear.save(tables, f"{tmp_path}/tables")
    loaded, stored = sinks.load_artifacts(f"{tmp_path}/fitted", list(MODELS)), linear.load(spark, f"{tmp_path}/tables")
    texts = ad.text_table(ad.table(spark, SF, "documents")).select("review_id", "text", "rating")
    schema = texts.schema
    for name, some in (("a", texts.limit(60)), ("b", texts.limit(90)), ("c", spark.createDataFrame([("x", None, 2.0)], schema))):
        some.coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    landed = spark.read.schema(schema).parquet(*[f"{tmp_path}/in/{n}" for n in "abc"])
    columns = ["review_id", "sentiment", "model_used", "primary_aspect", "issue", "priority", "suggested_action", "confidence"]
    for model in ("linearsvc", "logistic_regression"):
        want = rows(with_intelligence(models.score(landed, artifacts, model)).select(*columns))

        def run():
            stream = live.file_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
            live.append_to(live.score_stream(stream, loaded, model), f"{tmp_path}/{model}", f"{tmp_path}/{model}-state"
                           ).awaitTermination()
            live.append_batches(stream, f"{tmp_path}/{model}-t", f"{tmp_path}/{model}-t-state",
                                lambda b: with_intelligence(linear.score(b, "review_id", stored, model))
                                ).awaitTermination()
            return [rows(spark.read.parquet(f"{tmp_path}/{model}{t}").select(*columns)) for t in ("", "-t")]

        for _ in range(2):      # the second run starts on the same checkpoints and adds nothing
            assert all(near(got, want) for got in run())


def test_routing_is_one_pass(spark, trained):
    _, artifacts, tables = trained
    texts = ad.text_table(ad.table(spark, SF, "documents")).select(
        "review_id", "text", ad.pick(ad.MODEL_REQUESTS, F.col("row_order") % 7).alias("model_requested"))
    got = linear.score_routed(texts, "review_id", tables)
    want = models.score_routed(texts, artifacts)
    columns = ["review_id", "model_requested", "model_used", "sentiment", "confidence"]
    assert near(rows(got.select(*columns)), rows(want.select(*columns)))
    assert {r.model_used for r in got.collect()} == set(MODELS)


def test_machines_are_optimal(spark, trained):
    split, _, tables = trained
    at = [h.model for h in tables.heads].index("linearsvc")
    gradient = linear.optimality(split.filter("not is_test"), "review_id", tables, at)
    assert gradient.count() == tables.terms.count() * len(LABELS)
    assert gradient.agg(F.max(F.abs("gradient"))).first()[0] <= 1e-5


def test_machines_need_few_passes(spark):
    """Optimal within 60 passes over rows of common and rare terms, more rows than the sample holds."""
    draw, width = np.random.default_rng(5), 800
    data = []
    for i in range(4000):
        at = np.unique((width * draw.random(40) ** 3).astype(int))
        values = draw.random(len(at)) + 0.1
        data.append((LABELS[(int(at.sum()) + i % 2) % 3], Vectors.sparse(width, at, values / np.sqrt(values @ values))))
    train = spark.createDataFrame(data, ["sentiment", "features"])
    machines = margin.fit(train, 60)
    x = np.stack([np.append(v.toArray(), 1.0) for _, v in data])
    for c, machine in zip(LABELS, machines):
        w = np.append(machine.coefficients.toArray(), machine.intercept)
        side = np.array([1.0 if label == c else -1.0 for label, _ in data])
        gradient = w + x.T @ (-2 * side * np.maximum(0.0, 1 - side * (x @ w)))
        assert np.abs(gradient).max() / len(data) <= 1.01e-6


def test_gradient_is_that_of_the_loss(spark):
    """Against a difference quotient of the squared hinge and the log loss on a hand-made model."""
    import math
    texts = [("a", "good film", "positive"), ("b", "bad bad film", "negative"), ("c", "film plot", "neutral")]
    train = spark.createDataFrame(texts, "review_id string, clean_text string, sentiment string")

    def tables(step):
        terms = [("good", 1.5, [-0.2, 0.1, 0.4 + step] + [0.3, 0.2, 0.1 + step]), ("bad", 1.2, [0.5, 0.0, -0.4] * 2),
                 ("film", 1.0, [0.1, 0.1, 0.2] * 2)]
        heads = (linear.Head("logistic_regression", True, (0.1, 0.0, -0.1)),
                 linear.Head("linearsvc", False, (-0.5, -0.6, -0.4)))
        return linear.LinearModels(spark.createDataFrame(terms, linear.TERMS), heads)

    def losses(step):
        t = tables(step)
        out = [0.0, 0.0]
        for r in linear.margins(train, "review_id", t).collect():
            k, m = LABELS.index(r.sentiment), r.margins
            out[0] += math.log(sum(map(math.exp, m[:3]))) - m[k]
            out[1] += sum(max(0, 1 - (1 if i == k else -1) * x) ** 2 for i, x in enumerate(m[3:]))
        w = [[c for r in t.terms.collect() for c in r.coefs[i:i + 3]] for i in (0, 3)]
        return [(loss + sum(c * c for c in v) / 2) / 3 for loss, v in zip(out, w)]

    up, down = losses(1e-5), losses(-1e-5)
    for at in (0, 1):
        found = {(r.term, r["class"]): r.gradient for r in linear.optimality(train, "review_id", tables(0), at).collect()}
        assert abs(found["good", "positive"] - (up[at] - down[at]) / 2e-5) < 1e-8
