"""Dashboard analytics and filters on small hand-made tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kudoscope.operators import analytics as an, filters, store
from kudoscope.schemas import LABELS

COLUMNS = ("row_order long, review_id string, text string, title string, rating double, "
           "product string, verified_purchase boolean, helpful_votes int, date string, "
           "sentiment string")


@pytest.fixture(scope="module")
def reviews(spark):
    data = [
        (1, "a", "Arrived late", "t", 1.0, "P1", True, 3, "2020-01-05 10:00:00", "negative"),
        (2, "b", "late again", "t", 5.0, "P1", False, 0, "2020-04-01 00:00:00", "negative"),
        (3, "c", "gave me a rash", "t", 2.0, "P1", True, 9, "2020-04-02 00:00:00", "negative"),
        (4, "d", "soft and smooth", "Pump", 4.0, "P1", True, 1, None, "positive"),
        (5, "e", "lovely", "t", 2.0, "P2", True, 1, "2021-12-31 23:59:59", "positive"),
        (6, "f", "nothing", "t", 3.0, "P2", False, None, "2021-10-01 00:00:00", "neutral"),
        (7, "g", "no words", "t", 1.0, "P3", False, 2, "2021-10-01 00:00:00", "negative"),
    ]
    df = spark.createDataFrame(data, COLUMNS)
    return df.withColumn("date_dt", F.try_to_timestamp("date"))


def test_pulse_and_distributions(reviews):
    p = an.sentiment_pulse(reviews).first()
    assert p["total"] == 7 == sum(p[f"{c}_count"] for c in LABELS)
    assert abs(sum(p[f"{c}_pct"] for c in LABELS) - 100) < 1e-9
    only = an.class_distribution(reviews.filter("sentiment = 'neutral'"))
    assert rows(only) == [("negative", 0, 0.0), ("neutral", 1, 100.0), ("positive", 0, 0.0)]
    assert rows(an.class_distribution(reviews.limit(0))) == [(c, 0, 0.0) for c in LABELS]
    assert [r["rating"] for r in an.rating_distribution(reviews).collect()] == [1, 2, 3, 4, 5]


def test_trend_skips_missing_dates(reviews):
    assert rows(an.quarterly_trend(reviews), "as is") == [
        ("2020Q1", 1, 0, 0.0), ("2020Q2", 2, 0, 0.0), ("2021Q4", 3, 1, 33.3)]


def test_mismatch_summary(reviews):
    r = an.mismatch_summary(reviews).first()
    assert (r["over_rated"], r["under_rated"], r["total_mismatches"]) == (1, 1, 2)
    assert an.mismatch_summary(reviews.limit(0)).first()["mismatch_rate"] == 0


def test_complaints(reviews):
    got = {r["aspect"]: r for r in an.complaint_summary(reviews).collect()}
    assert got["Delivery"]["count"] == 2 and got["Delivery"]["issue"] == "Shipping Delay"
    assert got["Delivery"]["priority"] == "HIGH"
    quality = got["Product Quality"]            # the rash and the wordless complaint
    assert (quality["count"], quality["issue"]) == (2, "Adverse Skin Reaction")
    # the action is that of the first review by order, not the most frequent one
    assert quality["action"].startswith("Escalate") and quality["high_priority"] == 1
    assert an.high_priority_count(reviews).first()[0] == 1
    by_product = {(r["product"], r["aspect"]): r for r in an.product_complaints(reviews).collect()}
    p3 = by_product["P3", "Product Quality"]
    assert (p3["issue"], p3["share_pct"], p3["priority"]) == ("General Complaints", 100.0, "HIGH")
    assert round(by_product["P1", "Delivery"]["share_pct"], 2) == 66.67
    assert an.complaint_summary(reviews.filter("rating > 5")).count() == 0


def test_mode_tie_is_by_name(spark):
    df = spark.createDataFrame(
        [(1, "battered", 1.0, "negative", "P"), (2, "late", 1.0, "negative", "P")],
        "row_order long, text string, rating double, sentiment string, product string")
    assert rows(an.top_issue_per_aspect(df)) == [("Delivery", "Damaged in Transit")]


def test_kpis_and_derived(reviews):
    kpis = an.product_kpis(reviews)
    p1 = kpis.filter("product = 'P1'").first()
    assert (p1["total"], p1["negative_pct"], p1["avg_rating"], p1["verified_pct"]) == (4, 75, 3, 75)
    cover = dict(rows(an.date_coverage(kpis)))
    assert cover["P1"] == "Jan 2020 – Apr 2020"
    none = an.product_kpis(reviews.filter("review_id = 'd'"))
    assert rows(an.date_coverage(none)) == [("P1", "All Available")]
    tiers = {r["product"]: r for r in an.purchase_confidence(kpis).collect()}
    assert tiers["P1"]["tier"] == "AVOID" and tiers["P2"]["tier"] == "MIXED"
    assert abs(sum(tiers["P2"][b] for b in ("avoid", "mixed", "buy", "toptier")) - 100) < 0.2
    compared = an.product_compare(reviews, ["P3", "P1", "nope"]).collect()
    assert [r["product"] for r in compared] == ["P3", "P1"]
    with pytest.raises(ValueError):
        an.product_compare(reviews, list("abcde"))


@pytest.mark.parametrize("score,tier", [(-5, "AVOID"), (34.9, "AVOID"), (35, "MIXED"), (54.9, "MIXED"),
                                        (55, "BUY"), (79.9, "BUY"), (80, "TOP TIER"), (140, "TOP TIER")])
def test_tier_bounds(spark, score, tier):
    df = spark.createDataFrame([("P", float(score))], "product string, positive_pct double")
    r = an.purchase_confidence(df).first()
    assert r["tier"] == tier and 0 <= r["score"] <= 100


def test_narrative(reviews):
    text = dict(rows(an.product_narrative(an.product_kpis(reviews), an.product_complaints(reviews))))
    assert text["P1"] == (
        "Negative feedback represents a substantial share (75.0%, 3 reviews) for this product. "
        "Friction is primarily concentrated in Delivery (66.7%) and Product Quality (33.3%).")
    assert text["P2"].startswith("Customer sentiment is exclusively favorable across 2 reviews (50.0%")
    assert "(primarily General Complaints)" in text["P3"]


def test_catalog(reviews):
    first = an.product_catalog(reviews).first()
    assert first["label"] == "P1 (4 reviews)"
    assert dict(rows(an.product_counts(reviews.withColumn("product", F.lit("")))))["General"] == 7


def test_evidence(reviews):
    got = an.aspect_evidence(reviews, 1)
    assert {(r["product"], r["aspect"], r["row_order"]) for r in got.collect()} == {
        ("P1", "Delivery", 1), ("P1", "Product Quality", 3), ("P3", "Product Quality", 7)}


def test_filters(reviews):
    ids = lambda df: {r["review_id"] for r in df.collect()}     # noqa: E731
    f = filters.filter_reviews
    assert ids(f(reviews)) == set("abcdefg")
    assert ids(f(reviews, products=["All", "P1"])) == set("abcdefg")
    assert ids(f(reviews, products=["P2"])) == set("ef")
    assert ids(f(reviews, ratings=["1", 2.0, "x"])) == set("aceg")
    assert ids(f(reviews, ratings=["x"])) == set("abcdefg")
    assert ids(f(reviews, sentiments=["NEUTRAL"])) == {"f"}
    assert ids(f(reviews, verified_only=True)) == set("acde")
    assert ids(f(reviews, search=" LATE|pump ")) == set("abd")
    assert ids(f(reviews, search="late|pump", literal=True)) == set()


def test_feeds(reviews):
    order = lambda s, **k: [r["review_id"] for r in filters.feed_page(reviews, s, **k).collect()]
    assert order("Most Recent") == list("efgcbad")
    assert order("Highest Rating", page_size=3) == list("bdf")
    assert order("Lowest Rating", page_size=2) == list("ag")
    assert order("Most Helpful")[0] == "c"
    assert order("Mismatch Cases Only") == list("be")
    assert order("Lowest Rating", aspect="Delivery") == list("ab")
    assert rows(filters.feed_total(reviews, aspect="Delivery", page_size=1)) == [(1, 2)]
    with pytest.raises(ValueError):
        filters.feed_rows(reviews, "Oldest")


def test_store(spark, reviews):
    predictions = spark.createDataFrame([("a", "negative"), ("a", "negative"), ("d", "positive")],
                                        "review_id string, sentiment string")
    stored = reviews.select("review_id", "text", "product")
    page = store.stored_reviews(stored, predictions, sentiment=" Negative ")
    assert [r["review_id"] for r in page.collect()] == ["a", "a"]
    assert store.stored_reviews(stored, predictions, product="P2", skip=1).first()["review_id"] == "f"
    assert dict(rows(store.store_totals(stored, predictions))) == {"reviews": 7, "predictions": 3}
    scored = spark.createDataFrame([("x", " ", "positive", 0.9), ("y", "ok", "positive", 0.8)],
                                   "review_id string, text string, sentiment string, confidence double")
    assert rows(store.blank_gate(scored).drop("text")) == [
        ("x", "neutral", None, False), ("y", "positive", 0.8, True)]


def test_metrics_upsert(spark):
    stored = spark.createDataFrame([("lr", 0.1, 0.2), ("svc", 0.3, 0.4)],
                                   "model_name string, accuracy double, f1 double")
    fresh = spark.createDataFrame([("lr", 0.9, 0.8, 0.7), ("new", 0.5, 0.6, 0.5)],
                                  "model_name string, accuracy double, f1 double, precision double")
    got = {r["model_name"]: r for r in store.upsert_metrics(stored, fresh).collect()}
    assert set(got) == {"lr", "svc", "new"}
    assert (got["lr"]["accuracy"], got["lr"]["macro_f1"], got["lr"]["macro_precision"]) == (0.9, 0.8, 0.7)
    assert got["svc"]["macro_f1"] is None
    assert store.read_metrics(store.upsert_metrics(stored, fresh)).filter(
        "model_name = 'svc'").first()["macro_f1"] == 0.4


def test_deep_pages(spark):
    """Pages of any depth equal those of one sorted list; null keys first, equal keys together."""
    keys = [None, None, *[f"k{(i * 7919) % 5000:05d}" for i in range(5000)]]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "review_id string, n int").repartition(5)
    whole = sorted(keys, key=lambda k: (k is not None, k or ""))
    for skip, limit in ((0, 3), (1, 5), (2, 1), (1700, 40), (4990, 30), (4999, 10), (5002, 5), (9999, 5), (10, 0)):
        page = filters.deep_page(df, skip, limit, enough=20)
        assert [r["review_id"] for r in page.collect()] == whole[skip:skip + limit]
    assert filters.deep_page(df.limit(0), 0, 5).count() == 0
    tied = df.select(F.lit(1).alias("review_id"), "n")
    assert filters.deep_page(tied, 4000, 5, enough=20).count() == 5
    first = filters.page_after(df.filter("review_id IS NOT NULL"), None, 4)
    last = first.collect()[-1]["review_id"]
    after = filters.page_after(df, last, 4)
    assert [r["review_id"] for r in first.union(after).collect()] == whole[2:10]
