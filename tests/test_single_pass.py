"""Rows are read once and expressions evaluated once, whatever names them several times."""

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from kudoscope.functions import text as tx
from kudoscope.functions.columns import let
from kudoscope.operators import attribution, etl, filters, keyphrases, store
from kudoscope.operators.vectorise import FAN_OUT


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_let_hands_one_value_on(spark):
    assert one(spark, let(F.rand(), lambda r: r - r)) == 0.0


def test_cleaning_and_terms_evaluate_each_step_once(spark):
    df = spark.createDataFrame([("Don't <b>go</b> to www.x.y now 1",)], "t string")
    text = plan(df.select(tx.clean_text(F.col("t")).alias("c")))
    assert text.count("lower(") == 1 and text.count("<[^>]+>") == 1 and text.count("[^a-z]+") == 1
    terms = plan(df.select(F.explode(tx.ngrams(tx.words(F.col("t"))))))
    assert terms[:terms.index("\n\n") if "\n\n" in terms else None].count("split(t") == 1


def test_tokens_fan_out_in_small_partitions_and_weak_words_go_first(spark):
    coefs = spark.createDataFrame([("positive", "fine", 0.9), ("negative", "fine", 0.0)], "class string, term string, coef double")
    docs = spark.createDataFrame([(1, "Fine day, fine")], "doc long, text string")
    tokens = attribution.explain_tokens(docs, coefs, "doc")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {FAN_OUT * usual})" in plan(tokens)
    text = plan(attribution.top_words(tokens, "doc"))
    assert "abs(" in text[text.rindex("min(position"):]
    assert rows(attribution.top_words(tokens, "doc")) == [(1, "positive", 1, "fine", 0.9)]


def test_distributions_pass_the_reviews_once(spark):
    seen = spark.sparkContext.accumulator(0)
    data = [("negative", 1.0), ("negative", 5.0), (None, 5.0), ("positive", None)]

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    reviews = spark.createDataFrame(data, "sentiment string, rating double").mapInPandas(
        read, "sentiment string, rating double")
    got = {(r["section"], r["name"]): r["value"] for r in store.distribution_entries(reviews).collect()}
    assert seen.value == len(data)
    assert got == {
        ("class_count", "negative"): 2.0, ("class_count", "neutral"): 0.0, ("class_count", "positive"): 1.0,
        ("class_percentage", "negative"): 66.67, ("class_percentage", "neutral"): 0.0,
        ("class_percentage", "positive"): 33.33, ("rating_count", "1.0"): 1.0, ("rating_count", "5.0"): 2.0,
        ("rating_percentage", "1.0"): 33.33, ("rating_percentage", "5.0"): 66.67}


def test_quality_checks_pass_the_reviews_once(spark):
    data = [("r1", "a b", "positive", 4.0, etl.SOURCE), ("r1", "a b", "bad", 9.0, "x"), (None, None, None, None, None),
            (None, "", "neutral", 1.0, etl.SOURCE)]
    df = spark.createDataFrame(data, "review_id string, clean_text string, sentiment string, rating double, source string")
    got = etl.quality_checks(df)
    assert plan(got).count("Scan ExistingRDD") == 1
    assert rows(got, "as is") == [
        ("non_empty_clean_text", 2), ("label_domain", 2), ("rating_range", 2), ("constant_source", 2),
        ("unique_clean_text", 1), ("unique_review_id", 2)]
    assert {n for _, n in rows(etl.quality_checks(df.limit(0)))} == {0}


def test_deep_page_passes_the_rows_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS review_id").mapInPandas(read, "review_id long")
    got = filters.deep_page(df, 3210, 5, enough=10)
    assert rows(got, "as is") == [(i,) for i in range(3210, 3215)]
    assert seen.value == 3 * 5000  # draw, count, write the range


@pytest.mark.parametrize("pool", [1, 2, 7])
def test_pool_decides_on_time_only(spark, pool):
    rng = np.random.default_rng(5)
    data = [(g, i, [float(x) for x in rng.normal(size=6) + 0.5]) for g, n in (("a", 60), ("b", 4)) for i in range(n)]
    near = keyphrases.similarity_to_centre(spark.createDataFrame(data, "g string, id int, v array<double>"), "g", "v", 6)
    want = rows(keyphrases.mmr_select(near, "g", "id", "v", 5, 0.7, pool=60))
    assert len(want) == 9 and rows(keyphrases.mmr_select(near, "g", "id", "v", 5, 0.7, pool=pool)) == want
