"""ETL, dedup, sampling and splitting: hand cases, brute force, order independence."""

import gzip
import hashlib
import json
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kudoscope.operators import etl, ranking, splitting
from kudoscope.plans import pipelines
from kudoscope.schemas import RAW_REVIEW
from kudoscope.sources import readers, sinks

RECORDS = [
    {"rating": 5, "text": " Great stuff ", "title": "Wow", "user_id": "u1", "asin": "A",
     "timestamp": 1588687728923, "helpful_vote": 3, "verified_purchase": True},
    {"rating": 5.0, "text": "GREAT stuff!!", "title": "wow", "user_id": "u2", "asin": "",
     "parent_asin": "PA"},                                             # same clean text
    {"rating": 2.5, "text": "between bands"},
    {"rating": "abc", "text": "no number"},
    {"rating": 0, "text": "out of range"},
    {"rating": None, "text": "no rating"},
    {"rating": 1, "text": " ", "title": ""},                           # empty
    {"rating": 1, "text": "!!!", "title": "the"},                      # cleans to nothing
    {"rating": 3, "title": "only title", "timestamp": 0},
]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "reviews.jsonl.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        for r in RECORDS:
            f.write(json.dumps(r) + "\n")
        f.write("{broken json\n\n")
    df = readers.read_raw_reviews(spark, path)
    # file order is not kept by a distributed scan: an explicit key stands for it
    return df.withColumn("row_order", F.when(F.col("user_id") == "u1", 0)
                         .when(F.col("user_id") == "u2", 1).otherwise(2).cast("bigint"))


def test_gzip_scan_skips_bad_lines(raw):
    assert raw.count() == len(RECORDS)


def test_processed_table(raw):
    got = {r["text"]: r for r in etl.processed_reviews(raw).collect()}
    assert set(got) == {"Great stuff", ""}
    first = got["Great stuff"]
    key = "u1_A_1588687728923_Great stuff"
    assert first["review_id"] == "rev_" + hashlib.sha256(key.encode()).hexdigest()[:16]
    assert (first["sentiment"], first["date"], first["helpful_votes"], first["verified_purchase"],
            first["clean_text"]) == ("positive", "2020-05-05 14:08:48", 3, True, "great stuff wow")
    other = got[""]
    assert (other["title"], other["product"], other["date"], other["clean_text"]) == (
        "only title", "", "", "title")


def test_funnel(raw):
    f = etl.funnel(raw).first().asDict()
    assert f == dict(raw_rows=9, sampled_rows=9, invalid_rating=4, empty_text=1,
                     empty_clean_text=1, duplicate_clean_text=1, final_rows=2)
    half = etl.funnel(raw, raw.filter("rating IS NOT NULL")).first()
    assert (half["raw_rows"], half["sampled_rows"]) == (9, 8)


def test_funnel_of_lines(spark, tmp_path):
    """Blank and broken lines are source lines; sampling is by line and repeats."""
    lines = [*map(json.dumps, RECORDS), "{broken json", "", None, "[1]"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(3)
    f = pipelines.line_funnel(df).first().asDict()
    assert f == dict(raw_rows=13, sampled_lines=13, undecodable=4, sampled_rows=9, invalid_rating=4, empty_text=1,
                     empty_clean_text=1, duplicate_clean_text=1, final_rows=2)
    sinks.write_summary(etl.processed_reviews(readers.parse_json(df, "value", RAW_REVIEW).withColumn(
        "row_order", F.lit(1))), f"{tmp_path}/summary", pipelines.line_funnel(df))
    doc = spark.read.json(f"{tmp_path}/summary").first()["document"]
    assert doc["funnel"]["raw_rows"] == 13.0 and doc["funnel"]["undecodable"] == 4.0
    assert set(pipelines.line_funnel(df.limit(0)).first().asDict().values()) == {0}


def test_funnel_of_sampled_lines(spark):
    lines = [json.dumps({"rating": i % 7, "text": f"text {chr(97 + i % 26) * (i % 9)}", "user_id": f"u{i}"})
             if i % 5 else f"broken {i}" for i in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    f = pipelines.line_funnel(df, 0.3).first().asDict()
    drawn = [x for x in lines if hashlib.md5(f"{x}_{etl.SEED}".encode()).hexdigest()[:8] < format(
        int(0.3 * 2 ** 32), "08x")]
    assert f["raw_rows"] == 2000 and f["sampled_lines"] == len(drawn) and 500 < len(drawn) < 700
    assert f["undecodable"] == sum(x.startswith("broken") for x in drawn)
    dropped = ("invalid_rating", "empty_text", "empty_clean_text", "duplicate_clean_text", "final_rows")
    assert f["sampled_rows"] == f["sampled_lines"] - f["undecodable"] == sum(f[k] for k in dropped)
    assert f == pipelines.line_funnel(df.repartition(7), 0.3).first().asDict()


def test_quality_checks(raw):
    good = dict(rows(etl.quality_checks(etl.processed_reviews(raw))))
    assert len(good) == 6 and set(good.values()) == {0}
    bad = dict(rows(etl.quality_checks(etl.standardise(raw))))
    assert bad["label_domain"] == 4 and bad["rating_range"] == 3 and bad["unique_clean_text"] == 2


def test_etl_with_sampling_and_sinks(spark, raw, tmp_path):
    assert etl.sample_rate(701_528) == 85_000 * 1.05 / 701_528
    assert etl.sample_rate(100) == 1.0
    out = pipelines.run_etl(raw, target=85_000)
    sinks.write_reviews(out, f"{tmp_path}/table.parquet")
    sinks.write_reviews(out, f"{tmp_path}/table.csv", "csv")
    sinks.write_summary(out, f"{tmp_path}/summary", etl.funnel(raw))
    for path in ("table.parquet", "table.csv"):
        back = readers.load_reviews(spark, f"{tmp_path}/{path}", fmt=path.split(".")[1])
        assert rows(back.select("review_id", "text", "rating", "verified_purchase")) == rows(
            out.select("review_id", "text", "rating", "verified_purchase"))
    assert readers.load_reviews(spark, f"{tmp_path}/table.parquet", 1).count() == 1
    doc = spark.read.json(f"{tmp_path}/summary").first()["document"]
    assert doc["class_count"]["positive"] == 1.0 and doc["funnel"]["raw_rows"] == 9.0


def test_loader_defaults(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "review_id,text,title,rating,product,category,price,date,helpful_votes,"
        "verified_purchase,sentiment,source,clean_text\n"
        "a,\"two\nlines, \"\"quoted\"\"\",,bad,,,,2020-05-05 14:08:48,x,True,Positive,s,c\n"
        "b,,,4.0,P,,,not a date,7,,,s,c\n", encoding="utf-8")
    a, b = readers.load_reviews(spark, str(tmp_path / "r.csv"), fmt="csv").orderBy("review_id").collect()
    assert (a["text"], a["rating"], a["product"], a["helpful_votes"], a["verified_purchase"],
            a["sentiment"]) == ('two\nlines, "quoted"', 5.0, "Unknown", 0, True, "positive")
    assert str(a["date_dt"]) == "2020-05-05 14:08:48"
    assert (b["text"], b["rating"], b["helpful_votes"], b["verified_purchase"], b["sentiment"],
            b["date_dt"]) == ("", 4.0, 7, False, "neutral", None)


def test_legacy_shapes(spark):
    old = spark.createDataFrame([(1, "Good", None, "positive"), (2, None, "S", None)],
                                "row_order int, Review string, Summary string, Sentiment string")
    assert rows(etl.normalise_legacy(old).select("text", "sentiment")) == [
        (" S", None), ("Good ", "positive")]
    kept = old.withColumn("text", F.lit("mine"))
    assert etl.normalise_legacy(kept, overwrite_text=False).first()["text"] == "mine"
    assert etl.normalise_legacy(kept).first()["text"] == "Good "
    with pytest.raises(ValueError):
        etl.normalise_legacy(old.select("Sentiment"))
    with pytest.raises(ValueError):
        etl.normalise_legacy(old.select("Review", "Summary"))
    assert etl.preprocess(etl.normalise_legacy(old), "row_order").count() == 1


def labelled(spark, n=3000):
    # a third of all rows shares one text; classes are uneven
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("review_id"), F.col("id").alias("row_order"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id"))
         .alias("clean_text"),
        F.when(F.col("id") % 10 < 7, "positive").when(F.col("id") % 10 < 9, "negative")
         .otherwise("neutral").alias("sentiment"))


def test_dedup_keeps_first_under_any_partitioning(spark):
    df = labelled(spark)
    want = rows(df.groupBy("clean_text").agg(F.min("row_order")))
    for parts in (1, 3, 17):
        got = etl.dedup_clean_text(df.repartition(parts, F.rand(1)), "row_order")
        assert rows(got.select("clean_text", "row_order")) == want
    again = etl.dedup_clean_text(etl.dedup_clean_text(df, "row_order"), "row_order")
    assert again.count() == len(want)


@pytest.mark.parametrize("n", [7, 100, 3001])
def test_split_sizes_and_stability(spark, n):
    df = labelled(spark, n)
    split = splitting.stratified_split(df)
    got = rows(split.select("review_id", "is_test"))
    sizes = {r["sentiment"]: r["count"] for r in df.groupBy("sentiment").count().collect()}
    tests = {r["sentiment"]: r["count"]
             for r in split.filter("is_test").groupBy("sentiment").count().collect()}
    assert len(got) == n and sum(tests.values()) == math.ceil(0.2 * n)
    assert all(abs(tests.get(c, 0) - 0.2 * k) < 1 for c, k in sizes.items())
    again = splitting.stratified_split(df.repartition(13, F.rand(2)))
    assert rows(again.select("review_id", "is_test")) == got
    # brute force: the smallest draws of each class are the test rows
    ids = {r["review_id"]: r["sentiment"] for r in df.collect()}
    for c, k in tests.items():
        mine = sorted((hashlib.md5(f"{i}_42".encode()).hexdigest(), i) for i, s in ids.items() if s == c)
        assert {i for _, i in mine[:k]} == {i for i, t in got if t and ids[i] == c}


def test_leakage_counter(spark):
    split = splitting.stratified_split(etl.dedup_clean_text(labelled(spark), "row_order"))
    assert splitting.split_leakage(split).first()["overlap"] == 0
    leaky = spark.createDataFrame([("a", True), ("a", False), ("b", True)],
                                  "clean_text string, is_test boolean")
    assert splitting.split_leakage(leaky).first()["overlap"] == 1


def test_stratified_sample(spark):
    df = labelled(spark)
    sample = splitting.stratified_sample(df, 200)
    counts = dict(rows(sample.groupBy("sentiment").count()))
    assert counts == {"positive": 140, "negative": 40, "neutral": 20}
    assert splitting.stratified_sample(labelled(spark, 5), 200).count() == 5
    assert splitting.stratified_sample(labelled(spark, 50), 3).count() == 3


def test_bernoulli(spark):
    df = labelled(spark)
    kept = etl.bernoulli_sample(df, F.col("review_id"), 0.3).count()
    assert 800 < kept < 1000
    assert etl.bernoulli_sample(df, F.col("review_id"), 1.0).count() == 3000
    assert etl.bernoulli_sample(df, F.col("review_id"), 0.0).count() == 0


@pytest.mark.parametrize("k", [3, 40])
def test_top_per_group_with_a_hot_group(spark, k):
    df = labelled(spark).withColumn("v", F.col("row_order") % 11)
    got = ranking.top_per_group(df.repartition(9, F.rand(1)), ["clean_text"], [F.col("v").desc()],
                                k, "row_order")
    hot = sorted(((-(i % 11), i) for i in range(0, 3000, 3)))[:k]
    assert [(r["row_order"], r["rank"]) for r in got.filter("clean_text = 'same text'")
            .orderBy("rank").collect()] == [(i, n + 1) for n, (_, i) in enumerate(hot)]
    assert got.filter("clean_text <> 'same text'").count() == 2000
