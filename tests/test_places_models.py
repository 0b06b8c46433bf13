"""Place payloads, model fits, scoring, attribution and keyphrases."""

import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kudoscope.functions.labels import MODELS
from kudoscope.operators import analytics, attribution, keyphrases, margin, models, vectorise
from kudoscope.plans import pipelines, queries
from kudoscope.schemas import LABELS
from kudoscope.sources import readers, sinks

GOOD = ["excellent", "wonderful", "love", "great", "perfect"]
BAD = ["terrible", "awful", "broken", "hate", "worst"]
MEH = ["average", "okay", "ordinary", "plain", "mediocre"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(240):
        label, words = (("positive", GOOD), ("negative", BAD), ("neutral", MEH))[i % 4 % 3]
        text = " ".join(rng.choice(words, 3)) + f" item{chr(97 + i % 26)} box{chr(97 + i // 26)} "
        data.append((i, f"r{i}", text, "t", "P", float(1 + i % 5), 0, True, "2020-01-01", label))
    return spark.createDataFrame(data, "row_order long, review_id string, text string, title string, "
                                 "product string, rating double, helpful_votes int, "
                                 "verified_purchase boolean, date string, sentiment string")


@pytest.fixture(scope="module")
def split(corpus):
    return pipelines.prepare_training(corpus)


@pytest.fixture(scope="module")
def artifacts(split):
    return pipelines.train(split)


def test_vectoriser_matches_table_form(spark, split, artifacts):
    train = split.filter("NOT is_test")
    table = {(r[0], r[1]): r[2] for r in vectorise.tfidf_table(train, "review_id")
             .select("review_id", "term", "tfidf").collect()}
    terms = vectorise.vocabulary_of(artifacts.vectoriser)
    for r in artifacts.vectoriser.transform(train).select("review_id", "features").collect():
        vec = r["features"]
        assert abs(vec.norm(2) - 1) < 1e-9
        for i, v in zip(vec.indices, vec.values):
            assert abs(table.pop((r["review_id"], terms[i])) - v) < 1e-9
    assert not table


def test_scores(spark, artifacts):
    df = spark.createDataFrame([("excellent wonderful, love it",), ("terrible awful broken",),
                                ("average okay",), (" ",), ("the",), (None,)], "text string")
    for name in MODELS:
        got = models.score(df, artifacts, name).collect()
        assert [r["sentiment"] for r in got] == [
            "positive", "negative", "neutral", "neutral", "neutral", "neutral"]
        assert {r["model_used"] for r in got} == {name}
        sure = [r["confidence"] for r in got]
        assert sure[3:] == [None] * 3
        if name == "linearsvc":
            assert sure[:3] == [None] * 3
        else:
            assert all(1 / 3 <= c <= 1 for c in sure[:3])
    assert models.score(df, artifacts, "unknown").first()["model_used"] == models.DEFAULT_MODEL


def test_evaluation_and_persistence(split, artifacts, spark, tmp_path):
    records = {r["model_name"]: r for r in models.evaluate_models(split.filter("is_test"), artifacts)
               .collect()}
    assert set(records) == set(MODELS)
    total = split.filter("is_test").count()
    for r in records.values():
        assert r["accuracy"] > 0.95 and sum(map(sum, r["confusion_matrix"])) == total
    sinks.save_artifacts(artifacts, f"{tmp_path}/models")
    back = sinks.load_artifacts(f"{tmp_path}/models", list(MODELS))
    df = spark.createDataFrame([("wonderful box",), ("hate this",)], "text string")
    for name in MODELS:
        assert rows(models.score(df, back, name)) == rows(models.score(df, artifacts, name))
    sinks.write_label_info(split, f"{tmp_path}/labels")
    sinks.write_evaluation(models.evaluate_models(split.filter("is_test"), artifacts),
                           f"{tmp_path}/eval")
    assert spark.read.json(f"{tmp_path}/eval").count() == 3
    assert spark.read.json(f"{tmp_path}/labels").agg(F.sum("test_size")).first()[0] == total


def test_routed_and_external_scores(spark, artifacts):
    df = spark.createDataFrame([("great", "linearsvc"), ("hate", "nope"), ("great", "DistilBERT")],
                               "text string, model_requested string")
    used = {r["model_requested"]: r["model_used"] for r in models.score_routed(df, artifacts).collect()}
    assert used == {"linearsvc": "linearsvc", "nope": models.DEFAULT_MODEL,
                    "DistilBERT": models.DEFAULT_MODEL}

    def make():
        def predict(texts):
            return np.array([[0.7, 0.2, 0.1] if "hate" in t else
                             ([np.nan] * 3 if "great" in t else [0.3, 0.4, 0.3]) for t in texts])
        return predict

    texts = spark.createDataFrame([("i hate",), ("great",), ("weak",), ("",)], "text string")
    got = {r["text"]: r for r in models.score_external(texts, artifacts, make, threshold=0.5).collect()}
    assert (got["i hate"]["sentiment"], got["i hate"]["confidence"], got["i hate"]["model_used"]) == (
        "negative", 0.7, "distilbert")
    assert got["great"]["model_used"] == models.DEFAULT_MODEL and got["great"]["sentiment"] == "positive"
    assert got["weak"]["model_used"] == models.DEFAULT_MODEL
    assert (got[""]["sentiment"], got[""]["confidence"]) == ("neutral", None)
    assert {r["model_requested"] for r in got.values()} == {"distilbert"}


def test_keywords_and_report(spark, split, artifacts):
    coefs = models.coefficient_table(artifacts, "logistic_regression", split)
    top = models.class_keywords(coefs, 5)
    best = {r["class"]: r["term"] for r in top.filter("rank = 1").collect()}
    assert best["positive"] in GOOD and best["negative"] in BAD and best["neutral"] in MEH
    assert {(r["rank"] + r["position"]) for r in top.collect()} == {6}
    report = models.held_out_report(split, artifacts, 20)
    tests = {r[0] for r in split.filter("is_test").select("review_id").collect()}
    got = report.collect()
    assert len(report.columns) == 15 and {r["review_id"] for r in got} <= tests and len(got) == 20


def test_attribution(spark):
    weights = {"great": 0.81, "good": 0.8, "fine": 0.5, "ok": 0.51, "love": 2.0, "nice": 0.9,
               "super": 0.9, "bad": -0.81, "poor": -0.8, "meh": -0.5, "sad": -0.51, "hate": -2.0,
               "ugly": -0.9, "vile": -0.9, "flat": 0.0}
    coefs = spark.createDataFrame(
        [(c, t, v if c == "positive" else 0.0) for t, v in weights.items() for c in LABELS],
        "class string, term string, coef double")
    texts = {
        # seven positives: the five strongest, equal scores by first use
        1: "ok fine good great super nice LOVE it",
        # six negatives below the limit: the five lowest, least negative first
        2: "sad meh poor bad ugly vile hate",
        3: "Great, great! flat... unknown\n hate",
        4: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc int, text string")
    tokens = attribution.explain_tokens(df, coefs, "doc")
    bands = {r["token"]: (r["band"], r["diff"]) for r in tokens.collect()}
    assert bands["great"] == ("positive", 0.81) and bands["good"] == ("none", 0.8)
    assert bands["bad"] == ("negative", -0.81) and bands["poor"] == ("none", -0.8)
    assert bands["unknown"] == ("none", None) and bands["Great"] == ("positive", 0.81)
    joined = tokens.groupBy("doc").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "token"))), lambda s: s["token"]), ""))
    assert dict(rows(joined)) == {i: t for i, t in texts.items() if t}
    got = {}
    for r in attribution.top_words(tokens, "doc").orderBy("doc", "kind", "rank").collect():
        got.setdefault((r["doc"], r["kind"]), []).append((r["word"], r["score"]))
    assert got == {
        (1, "positive"): [("love", 2.0), ("super", 0.9), ("nice", 0.9), ("great", 0.81), ("good", 0.8)],
        (2, "negative"): [("poor", 0.8), ("bad", 0.81), ("ugly", 0.9), ("vile", 0.9), ("hate", 2.0)],
        (3, "positive"): [("great", 0.81)],
        (3, "negative"): [("hate", 2.0)],
    }
    assert attribution.surrogate("distilbert") == models.DEFAULT_MODEL
    assert attribution.surrogate("linearsvc") == "linearsvc"


def mmr_plain(vectors, similarity, n, diversity):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = [int(np.argmax(similarity))]
    while len(chosen) < min(n, len(vectors)):
        rest = [i for i in range(len(vectors)) if i not in chosen]
        score = [(1 - diversity) * similarity[i] - diversity * max(unit[i] @ unit[c] for c in chosen)
                 for i in rest]
        chosen.append(rest[int(np.argmax(score))])
    return chosen


@pytest.mark.parametrize("diversity", [0.0, 0.5, 0.9])
def test_mmr_against_brute_force(spark, diversity):
    rng = np.random.default_rng(9)
    data, want = [], {}
    for g, size in (("a", 90), ("b", 4)):
        v = rng.normal(size=(size, 6)) + 0.5
        centre = v.mean(axis=0)
        sim = v @ centre / np.linalg.norm(v, axis=1) / np.linalg.norm(centre)
        want[g] = mmr_plain(v, sim, 5, diversity)
        data += [(g, i, [float(x) for x in v[i]]) for i in range(size)]
    df = spark.createDataFrame(data, "g string, id int, v array<double>")
    near = keyphrases.similarity_to_centre(df, "g", "v", 6)
    got = {}
    for r in keyphrases.mmr_select(near, "g", "id", "v", 5, diversity).orderBy("g", "turn").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == want


def test_keyphrases(spark, corpus, split):
    got = keyphrases.keyphrases_by_sentiment(split, 3)
    assert dict(rows(got.groupBy("sentiment").count())) == {c: 3 for c in LABELS}
    # the same, however many tasks read the texts
    assert rows(keyphrases.keyphrases_by_sentiment(split.repartition(3), 3)) == rows(got)


def test_no_word_is_left_out(spark):
    words = [f"w{i}" for i in range(12_000)]
    texts = [(LABELS[i % 3], " ".join(words[i:i + 4])) for i in range(0, 12_000, 4)]
    df = spark.createDataFrame(texts, "sentiment string, clean_text string")
    tokens = df.select(F.split("clean_text", " ").alias("words"))
    assert keyphrases.word_vectors(tokens, 8).count() == 12_000


def test_vectors_of_another_length_are_refused(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0, 3.0])], "g string, id int, v array<double>")
    with pytest.raises(Exception, match="vectors of 2 numbers"):
        keyphrases.similarity_to_centre(df, "g", "v", 2).collect()


PAYLOAD = {"id": "p1", "displayName": {"text": "Cafe"}, "rating": 4.5, "reviews": [
    {"text": {"text": "excellent wonderful"}, "rating": 1,
     "authorAttribution": {"displayName": "Ann", "uri": "u", "photoUri": "f"},
     "relativePublishTimeDescription": "a week ago", "publishTime": "2024"},
    {"originalText": {"text": "terrible awful"}, "rating": 5, "authorAttribution": {},
     "relativePublishTimeDescription": "", "publishTime": "2023"},
    {"text": {"text": "  "}, "rating": 3}, {"rating": 3}]}


def test_place_pipeline(spark, artifacts):
    bodies = [json.dumps(PAYLOAD), json.dumps({"id": "p2"}), "{broken"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {(r["place_id"], r["name"], r["user_rating_count"])
            for r in readers.place_details(df).collect()} == {("p1", "Cafe", 0), ("p2", "Unknown Place", 0)}
    scored, pulse = pipelines.analyse_places(df, artifacts)
    got = {r["author_name"]: r for r in scored.collect()}
    assert set(got) == {"Ann", "Anonymous Google Reviewer"} and len(scored.columns) == 20
    ann, other = got["Ann"], got["Anonymous Google Reviewer"]
    assert (ann["sentiment"], ann["is_mismatch"], ann["date"]) == ("positive", True, "a week ago")
    assert (other["sentiment"], other["is_mismatch"], other["date"], other["author_uri"]) == (
        "negative", True, "2023", "")
    assert rows(scored.select("review_id")) == rows(
        pipelines.analyse_places(df, artifacts)[0].select("review_id"))
    p = pulse.first()
    assert (p["total_reviews"], p["positive_pct"], p["neutral_pct"], p["negative_pct"],
            p["mismatch_pct"]) == (2, 50.0, 0.0, 50.0, 100.0)
    empty = analytics.place_pulse(scored.withColumn("sentiment", F.lit(None).cast("string")))
    assert empty.first()["positive_pct"] == 0.0


def test_place_analysis_carries_the_pulse(spark, artifacts, monkeypatch):
    bodies = [json.dumps(PAYLOAD), json.dumps({"id": "p2"}), json.dumps({**PAYLOAD, "id": None})]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    monkeypatch.setattr(queries.ad, "place_payloads", lambda *_: df)
    monkeypatch.setattr(queries, "_artifacts", lambda *_: artifacts)
    got = queries.place_analysis(spark, None)
    assert [c for c in got.columns if got.columns.count(c) > 1] == []
    assert {(r["place_id"], r["author_name"], r["sentiment"], r["overall_rating"], r["total_reviews"],
             r["positive_count"], r["negative_pct"], r["mismatch_pct"]) for r in got.collect()} == {
        ("p1", "Ann", "positive", 4.5, 2, 1, 50.0, 100.0),
        ("p1", "Anonymous Google Reviewer", "negative", 4.5, 2, 1, 50.0, 100.0),
        ("p2", None, None, None, 0, 0, 0.0, 0.0),
        (None, "Ann", "positive", 4.5, None, None, None, None),
        (None, "Anonymous Google Reviewer", "negative", 4.5, None, None, None, None)}


def test_search_and_status(spark):
    body = json.dumps({"places": [{"id": f"x{i}", "displayName": {"text": f"n{i}"}} for i in range(12)]
                       + [{"id": "z"}]})
    found = readers.place_search(spark.createDataFrame([("q", body)], "query string, body string"))
    assert found.count() == 10 and found.filter("rank = 10").first()["place_id"] == "x9"
    want = {200: (None, None), 400: ("AUTHENTICATION_OR_PERMISSION_ERROR",) * 2,
            401: ("AUTHENTICATION_OR_PERMISSION_ERROR",) * 2,
            403: ("AUTHENTICATION_OR_PERMISSION_ERROR",) * 2, 404: ("INVALID_PLACE_ID", "API_ERROR"),
            429: ("QUOTA_EXCEEDED",) * 2, 503: ("DETAILS_FETCH_FAILED", "API_ERROR")}
    df = spark.createDataFrame([(s,) for s in want], "s int")
    got = df.select("s", readers.response_class(F.col("s"))["error"],
                    readers.response_class(F.col("s"), False)["error"]).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_batch_sources_and_exports(spark, artifacts, tmp_path):
    block = spark.createDataFrame([("  good one \n\n  \nterrible, awful\r\n",)], "t string")
    assert rows(readers.pasted_lines(block, "t")) == [(0, "good one"), (3, "terrible, awful")]
    (tmp_path / "up.csv").write_text('id,body\n1,"wonderful, ""really"""\n2,\n3,7\n', encoding="utf-8")
    batch = readers.read_batch_csv(spark, str(tmp_path / "up.csv"), "body")
    assert rows(batch) == [('7',), ('wonderful, "really"',)]
    scored = models.score(batch, artifacts)
    sinks.write_scored_batch(scored, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    log = scored.withColumns({"review_id": F.xxhash64("text").cast("string"), "model_requested": F.lit("x"),
                              "timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp"),
                              "product": F.lit("P")})
    for _ in range(2):  # a retried batch adds nothing
        sinks.append_log(log, f"{tmp_path}/log")
        sinks.append_reviews(log, f"{tmp_path}/reviews")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert spark.read.parquet(f"{tmp_path}/reviews").count() == 2
    later = log.withColumn("timestamp", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    sinks.append_log(later, f"{tmp_path}/log")
    sinks.append_reviews(later, f"{tmp_path}/reviews")
    again = spark.read.parquet(f"{tmp_path}/log")
    assert again.count() == 4 and again.select("prediction_id").distinct().count() == 4
    assert spark.read.parquet(f"{tmp_path}/reviews").count() == 2
    products = spark.createDataFrame(
        [("A", 1.0, "negative", True, "t", "x\ny"), ("B", 5.0, "positive", False, "", 'q"')],
        "product string, rating double, sentiment string, verified_purchase boolean, title string, "
        "text string")
    sinks.write_product_audit(products, f"{tmp_path}/audit")
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .csv(f"{tmp_path}/audit"))
    assert {(r["product"], r["text"]) for r in back.collect()} == {("A", "x\ny"), ("B", 'q"')}
    stored = spark.createDataFrame([("lr", 0.1)], "model_name string, accuracy double")
    stored.write.parquet(f"{tmp_path}/m1")
    sinks.upsert_metrics(spark, f"{tmp_path}/m1", stored.withColumn("accuracy", F.lit(0.7)), f"{tmp_path}/m2")
    assert spark.read.parquet(f"{tmp_path}/m2").first()["accuracy"] == 0.7


def test_catalogue_audit(spark, tmp_path):
    """A hot product lies in several files, a million products in no more files; one is read from its own."""
    path = f"{tmp_path}/catalogue"
    ids = spark.range(6000).withColumnRenamed("id", "row_order")
    product = (F.when(F.col("row_order") % 3 == 0, "hot").when(F.col("row_order") == 1, F.lit(None))
               .when(F.col("row_order") == 2, "").otherwise(F.concat(F.lit("p"), "row_order")))
    df = ids.select("row_order", product.alias("product"), F.lit(4.0).alias("rating"), F.lit("positive").alias("sentiment"),
                    F.lit(True).alias("verified_purchase"), F.lit("t").alias("title"), F.lit('x\n"y"').alias("text"))
    sinks.write_catalogue_audit(df, path, files=8)
    held = readers.catalogue_manifest(spark, path)
    assert held.select("file").distinct().count() <= 8
    assert 1 < held.filter("product = 'hot'").count() < 8
    assert held.agg(F.sum("rows")).first()[0] == 6000 and held.filter("product IS NULL").first()["rows"] == 1
    assert readers.read_catalogue_audit(spark, path, "hot").count() == 2000
    one = readers.read_catalogue_audit(spark, path, "p7")
    assert [r["text"] for r in one.collect()] == ['x\n"y"'] and len(one.inputFiles()) == 1
    assert readers.read_catalogue_audit(spark, path, "").count() == 1
    assert readers.read_catalogue_audit(spark, path, "none").count() == 0
    assert readers.read_catalogue_audit(spark, path).count() == 6000
    sinks.write_catalogue_audit(df.limit(0), f"{tmp_path}/none", files=8)
    assert readers.catalogue_manifest(spark, f"{tmp_path}/none").count() == 0
    assert readers.read_catalogue_audit(spark, f"{tmp_path}/none").count() == 0


def test_totals_hold_nothing_per_document(spark):
    """Totals and document counts as by a plain count; no aggregate or shuffle by document."""
    from collections import Counter
    texts = ["good film good film", "film plot", "", None, "a b", "plot", "good plot film good"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id int, clean_text string")
    total, docs = Counter(), Counter()
    for t in texts:
        words = [w for w in (t or "").split(" ") if len(w) >= 2]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        total.update(terms)
        docs.update(set(terms))
    found = vectorise.vocabulary(vectorise.term_totals(df))
    assert {r["term"]: (r["total"], r["df"]) for r in found.collect()} == {t: (total[t], docs[t]) for t in total}
    plan = vectorise.tfidf_table(df, "review_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(review_id") == 1


def test_texts_fan_out_in_small_partitions(spark):
    """More partitions than usual where texts become terms, and not put together by the texts' size."""
    df = spark.createDataFrame([(i, "good film plot") for i in range(50)], "review_id int, clean_text string")
    terms = vectorise.document_terms(df, "review_id")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(review_id#" in (plan := terms._jdf.queryExecution().executedPlan().toString())
    assert f", {vectorise.FAN_OUT * usual}), REPARTITION_BY_NUM" in plan
    assert terms.count() == 50 * 5


def _texts(spark, n: int = 300):
    """Few frequent words, many rare ones, and a word that only one long text repeats."""
    draw = np.random.default_rng(3)
    lines = [" ".join([f"w{chr(97 + int(i) % 26)}{chr(97 + int(i) // 26 % 26)}" for i in draw.zipf(1.4, 30)]) for _ in range(n)]
    lines[7] += " burst" * 500
    return spark.createDataFrame(list(enumerate([*lines, "", None, "x"])), "review_id int, clean_text string")


@pytest.mark.parametrize("sample_rows, groups", [(10_000, 1 << 20), (40, 1 << 20), (40, 8), (1, 64)])
def test_frequent_terms_whatever_the_sample(spark, sample_rows, groups):
    df = _texts(spark)
    for size in (5, 60, 100_000):
        wanted = [r["term"] for r in vectorise.vocabulary(vectorise.term_totals(df), size)
                  .orderBy(F.col("total").desc(), "term").collect()]
        assert vectorise.frequent_terms(df, size=size, sample_rows=sample_rows, groups=groups) == wanted


def test_vocabulary_is_counted_under_a_bounded_number_of_keys(spark, monkeypatch):
    """Whatever the number of distinct terms, the pass over all rows holds no more keys than asked."""
    held = []
    keep = vectorise.materialise
    monkeypatch.setattr(vectorise, "materialise", lambda df, name: held.append(df.count()) or keep(df, name))
    df = _texts(spark)
    assert vectorise.term_totals(df).count() > 3 * 5 + 8
    vectorise.frequent_terms(df, size=5, sample_rows=40, groups=8)
    assert held and max(held) <= 3 * 5 + 8


def test_a_fit_does_not_keep_the_features_twice(split, monkeypatch):
    _, featured = pipelines.featurise(split)
    monkeypatch.setattr(type(featured), "persist", lambda *a: pytest.fail("kept beside the blocks of the fit"))
    assert pipelines.fit("balanced_logistic_regression", featured).stages


def test_margin_steps_know_terms_that_the_sample_missed():
    sample = [(np.array([0, 1], dtype="int8"), np.array([2, 2]), np.array([0, 3, 1, 3]), np.array([1.0, 1.0, 1.0, 1.0]))]
    solve = margin._shaper(sample, 10, np.array([5.0, 5.0, 50.0, 10.0]))(np.zeros((3, 4)))
    got = solve(np.array([[0.0, 0.0, 1.0, 0.0]] * 3))
    assert np.allclose(got[:, 2], 1 / (1 + 2 * margin._REST * 50)) and np.allclose(got[:, [0, 1, 3]], 0)
