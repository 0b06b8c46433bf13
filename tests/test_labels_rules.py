"""Value rules and rule intelligence against hand cases and SQL substring search."""

import random

import duckdb
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from kudoscope.functions import labels, rules
from kudoscope.plans import oracle


@pytest.mark.parametrize("raw,label", [
    ("1", "negative"), ("1.5", "negative"), ("2", "negative"), ("2.5", None), ("3", "neutral"),
    ("3.5", None), ("4", "positive"), ("5", "positive"), ("0", None), ("6", None), ("abc", None),
    (None, None)])
def test_rating_to_sentiment(spark, raw, label):
    assert one(spark, labels.rating_to_sentiment(F.col("r").cast("string")), r=raw) == label


@pytest.mark.parametrize("rating,sentiment,flag", [
    (5.0, "negative", True), (4.0, "negative", True), (3.0, "negative", False),
    (2.0, "positive", True), (1.0, "positive", True), (5.0, "positive", False),
    (None, "negative", False), (5.0, None, False)])
def test_mismatch(spark, rating, sentiment, flag):
    got = one(spark, labels.is_mismatch(F.col("r").cast("double"), F.col("s").cast("string")),
              r=rating, s=sentiment)
    assert got is flag


@pytest.mark.parametrize("raw,text", [
    ("3", "★★★☆☆ 3/5"), ("2.5", "★★☆☆☆ 2/5"), ("3.5", "★★★★☆ 4/5"), ("0", "★☆☆☆☆ 1/5"),
    ("9", "★★★★★ 5/5"), ("bad", "★★★★★ 5/5"), (None, "★★★★★ 5/5")])
def test_star_label(spark, raw, text):
    assert one(spark, labels.star_label(F.col("r").cast("string")), r=raw) == text


def test_model_resolution(spark):
    assert labels.resolve_model("single") == "linearsvc"
    assert labels.resolve_model("single", "a", "b") == "a"
    assert labels.resolve_model("batch") == "balanced_logistic_regression"
    assert labels.resolve_model("batch", "a", "b") == "b"
    with pytest.raises(ValueError):
        labels.resolve_model("other")
    for asked, used in (("linearsvc", "linearsvc"), ("DistilBERT", "distilbert"),
                        ("nope", "balanced_logistic_regression"),
                        (None, "balanced_logistic_regression")):
        assert one(spark, labels.route_model(F.col("m").cast("string")), m=asked) == used
    for raw, label in (("LABEL_0", "negative"), ("label_2", "positive"), ("Neutral", "neutral"),
                       ("Mixed", "mixed")):
        assert one(spark, labels.normalise_label(F.col("m")), m=raw) == label


def intelligence(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, text string, sentiment string, rating double")
    out = rules.with_intelligence(df).orderBy("i").collect()
    return [(r.primary_aspect, r.all_aspects, r.issue, r.priority, r.suggested_action) for r in out]


def test_cases(spark):
    got = intelligence(spark, [
        ("Nothing to say.", "neutral", 3.0),
        ("The chocolate was fine", "neutral", 3.0),             # late inside chocolate
        ("awful smell", "negative", 3.0),                       # rule agrees with an aspect
        ("rude people", "negative", 1.0),                       # rule brings its own aspect
        ("late and leaking", "negative", 1.0),                  # first rule wins
        ("It is broken and terrible", "neutral", 3.0),          # severe but not negative
        ("nice", "positive", 1.0),                              # one star outranks the label
        ("escape", "positive", 5.0),                            # cap inside escape
        (None, "positive", 5.0),
    ])
    assert got[0] == ("Product Quality", ["General"], "General Feedback", "LOW", rules.NEUTRAL_ACTION)
    assert got[1][0:3] == ("Delivery", ["Delivery"], "Shipping Delay")
    assert got[2][0:4] == ("Product Quality", ["Product Quality"], "Poor Formula Quality", "MEDIUM")
    assert got[3][0:3] == ("Customer Service", ["Customer Service"], "Unresponsive Support")
    assert got[4][0:3] == ("Delivery", ["Delivery", "Packaging"], "Shipping Delay")
    assert got[5][3] == "LOW"
    assert got[6][3:] == ("MEDIUM", rules.NEGATIVE_ACTION)
    assert got[7][0] == "Packaging" and got[7][4] == rules.POSITIVE_ACTION
    assert got[8][0:2] == ("Product Quality", ["General"])


def in_sql(cases):
    frame = pd.DataFrame(cases, columns=["text", "sentiment", "rating"])
    frame["i"] = range(len(cases))
    found = duckdb.sql(f"""WITH {oracle.intelligence('frame')}
        SELECT primary_aspect, all_aspects, issue, priority, suggested_action FROM intel ORDER BY i""")
    return [tuple(r) for r in found.fetchall()]


def test_single_scan_equals_substring_search(spark):
    rng = random.Random(3)
    keys = list(rules.ALL_KEYWORDS)
    cases = []
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.choice(keys)
            cut = rng.randint(1, len(k))
            parts.append(rng.choice([k, k[:cut], k[cut:], k.upper(), "xx", "de", "bro"]))
        text = rng.choice(["", " "]).join(parts)
        cases.append((text, rng.choice(["negative", "neutral", "positive"]),
                      float(rng.randint(1, 5))))
    assert intelligence(spark, cases) == in_sql(cases)


def test_each_keyword_alone(spark):
    cases = [(k, "neutral", 3.0) for k in rules.ALL_KEYWORDS]
    assert intelligence(spark, cases) == in_sql(cases)
    assert sum(map(len, rules.ASPECT_KEYWORDS.values())) == 104
    assert sum(len(r[2]) for r in rules.ISSUE_RULES) == 61
