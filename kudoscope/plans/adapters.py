"""Review-shaped views of the TPC-H-like and text tables used for tests and benchmarks.

Each view is a plain projection (at most one join) over the whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.operators import etl, linear
from kudoscope.schemas import LABELS, REVIEW
from kudoscope.session import materialise
from kudoscope.sources.readers import spread

# Short English sentences that exercise every aspect, rule and severe term.
PHRASES = (
    "Arrived late again, the carrier never called.",
    "It came in a crushed box, clear transit damage.",
    "The pump doesn't work and nothing comes out.",
    "The seal broken, cream leaked all over my bag.",
    "Gave me a rash and an itchy breakout overnight.",
    "Feels cheap and the awful smell stays for hours.",
    "Amazing results, soft skin after three days!",
    "The seller gave no response, customer service can't help.",
    "They refused refund twice, return hassle ever since.",
    "Overpriced and not worth the money in my view.",
    "Great price, truly worth every penny.",
    "Easy to use but heavy and slow to absorb.",
    "Long lasting hold, good coverage that won't fade.",
    "Good chocolate scent, nothing more to say.",
    "I wouldn't buy it twice, it's so-so.",
    "A fraud and a danger, it burned my hand!",
)
TITLES = ("Late again", "Fine", "Broken pump", "Love it <3", "Never & never", "So-so", "Wow!", "")
MODEL_REQUESTS = ("logistic_regression", "balanced_logistic_regression", "linearsvc",
                  "distilbert", "DistilBERT", "svm", "")
RAW_LABELS = ("Positive", "LABEL_0", "label_1", "LABEL_2", "NEGATIVE", "neutral", "other")
STATUSES = (200, 403, 404, 429, 500)


# Work on these is per character; on the numeric tables a scan is cheaper than a shuffle.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def pick(values: tuple, index: Column) -> Column:
    """``values[index]``, zero-based."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def relational_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without text: one per line item; the return flag stands in for text polarity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        tx.hashed_id("rev_", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                     F.col("l_suppkey"), F.col("l_quantity").cast("bigint"),
                     F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("review_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "neutral")
         .otherwise("positive").alias("sentiment"),
        (F.col("l_linestatus") == "F").alias("verified_purchase"),
        F.col("l_linenumber").cast("int").alias("helpful_votes"),
        F.col("l_shipdate").alias("date_dt"),
        F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        pick(labels.MODELS, F.col("l_linenumber") % 3).alias("model_used"),
        pick(MODEL_REQUESTS, F.col("l_linenumber") - 1).alias("model_requested"))


def judged(df: DataFrame) -> DataFrame:
    """Actual label (from stars) beside the stand-in prediction."""
    return df.select(F.col("model_used").alias("model_name"),
                     labels.rating_to_sentiment(F.col("rating")).alias("actual"),
                     F.col("sentiment").alias("predicted"))


def _label_class() -> Column:
    return (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral")
            .when(F.col("quality") == 1, "positive"))


def text_table(documents: DataFrame) -> DataFrame:
    """Documents as reviews with text, labelled by their stars."""
    day = F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") * 7 % 2000).cast("int"))
    text = F.concat(pick(PHRASES, F.col("doc_id") % 16), F.lit(" "), F.col("text"))
    rating = (1 + F.col("doc_id") % 5).cast("double")
    return documents.select(
        F.col("doc_id").alias("row_order"), text.alias("text"),
        pick(TITLES, F.col("doc_id") % 8).alias("title"), rating.alias("rating"),
        F.col("source").alias("product"), (F.col("doc_id") % 3 != 0).alias("verified_purchase"),
        (F.col("n_chars") % 23).cast("int").alias("helpful_votes"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("date"),
        day.cast("timestamp_ntz").alias("date_dt"),
        tx.hashed_id("rev_", F.col("doc_id"), F.col("source"), text).alias("review_id"),
        labels.rating_to_sentiment(rating).alias("sentiment"))


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_table`` with the class of ``labels`` where a document has one."""
    docs = text_table(table(spark, sf_dir, "documents"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_order"),
                                                  _label_class().alias("_label"))
    return (docs.join(marks, "row_order", "left")
            .withColumn("sentiment", F.coalesce("_label", "sentiment")).drop("_label"))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their class; null class where unlabelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_order"), "text", _label_class().alias("sentiment"),
        tx.hashed_id("rev_", F.col("doc_id"), F.col("source"), F.col("text")).alias("review_id"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review records: stars 0-6, missing titles, products and dates."""
    d = table(spark, sf_dir, "documents")
    ms = (F.lit(1514764800) + F.col("doc_id") * 7 % 2000 * 86400) * 1000
    return d.select(
        F.col("doc_id").alias("row_order"), (F.col("n_chars") % 7).cast("string").alias("rating"),
        "text", F.nullif(F.col("lang"), F.lit("en")).alias("title"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("user_id"),
        F.when(F.col("source") != "src8", F.when(F.col("source") == "src9", "")
               .otherwise(F.col("source"))).alias("asin"),
        F.concat(F.lit("parent_"), F.col("source")).alias("parent_asin"),
        F.when(F.col("lang") == "de", 0).otherwise(ms).cast("bigint").alias("timestamp"),
        F.nullif(F.col("n_chars") % 23, F.lit(0)).cast("int").alias("helpful_vote"),
        F.when(F.col("lang") != "fr", F.col("doc_id") % 3 != 0).alias("verified_purchase"))


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as JSON lines; some are cut short and some are blank."""
    raw = raw_reviews(spark, sf_dir)
    line = F.to_json(F.struct(*[c for c in raw.columns if c != "row_order"]))
    cut = F.concat(F.lit('{"rating": '), line)
    return raw.select(F.when(F.col("row_order") % 10 == 7, cut).when(F.col("row_order") % 50 == 3, " ")
                      .otherwise(line).alias("value"))


def loosely_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review columns as text with the gaps a left join leaves."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("row_order"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("text"),
        F.when(F.col("toxic") == 1, F.col("lang")).alias("title"),
        F.when(F.col("quality") == 1, "4.5").when(F.col("quality") == 0, "bad").alias("rating"),
        F.col("toxic").cast("string").alias("helpful_votes"),
        F.when(F.col("quality") == 1, "true").alias("verified_purchase"),
        F.nullif(F.col("source"), F.lit("src8")).alias("product"),
        F.upper(_label_class()).alias("sentiment"),
        F.when(F.col("toxic") == 1, F.col("lang"))
         .when(F.col("toxic") == 0, "2020-02-29 12:00:01").alias("date"))


def mistyped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines whose fields vary in type; one in ten does not decode."""
    k, d = F.col("doc_id") % 6, table(spark, sf_dir, "documents")
    quoted = F.regexp_extract(F.to_json(F.struct("text")), '(?s)^\\{"text":(.*)\\}$', 1)

    def one_of(*values: str) -> Column:
        return pick(values, k)

    fields = {
        "asin": F.concat(F.lit('"d'), "doc_id", F.lit('"')),
        "rating": one_of("5", '"4.0"', "3.0", '"abc"', "null", "2"),
        "helpful_vote": one_of("3", '"3"', "3.0", "null", '"x"', "7.9"),
        "timestamp": one_of("1600000000000", '"1600000000000"', "1600000000000.0", "null", "1", "0"),
        "verified_purchase": one_of("true", '"true"', '"false"', "1", "null", "false"),
        "text": F.coalesce(F.nullif(quoted, F.lit("")), F.lit("null")),
    }
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items()])
    line = F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit('{"asin": '), body)).otherwise(
        F.concat(F.lit("{"), body, F.lit("}")))
    return d.select(line.alias("value"))


def mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place payload per conversation turn with fields of other types and three reviews."""
    k, c = F.col("turn") % 3, table(spark, sf_dir, "conversations")
    body = F.format_string(
        '{"id":"m%d_%d","displayName":%s,"rating":%s,"userRatingCount":%s,"reviews":['
        '{"text":"plain %d","rating":"5"},{"text":{},"originalText":{"text":"original %d"},"rating":4},'
        '{"text":{"text":"object %d"},"originalText":{"text":"no"},"rating":3.0},{"text":{"text":""}}]}',
        "conv_id", "turn", pick(('{"text":"Place"}', '"Place"', "null"), k), pick(("4.5", '"4.5"', "null"), k),
        pick(("7.0", '"7"', "7"), k), "turn", "turn", "turn")
    return c.select(body.alias("body"))


def csv_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the processed columns, numbers and dates written in several ways."""
    k, d = F.col("doc_id") % 4, table(spark, sf_dir, "documents")
    values = {
        "review_id": F.col("doc_id").cast("string"), "text": F.col("text"),
        "rating": pick(("4.0", "3", "bad", "1.0"), k), "helpful_votes": pick(("3.0", "3", "x", "0"), k),
        "verified_purchase": pick(("true", "True", "no", "1"), k),
        "date": pick(("2020-02-29 12:00:01", "2020-02-29T12:00:01", "2020-02-29", "29 February"), k)}
    return d.select(*[values.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in REVIEW])


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as one text of a batch, with a stand-in score."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    n = F.length("text")
    return lines.withColumns({"sentiment": pick(LABELS, n % 3),
                              "confidence": (n % 100) / F.lit(100.0)})


def place_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One details payload per conversation turn, as JSON text."""
    c = table(spark, sf_dir, "conversations")
    said = F.struct(F.col("text"))
    no_text = F.lit(None).cast("struct<text:string>")
    system = F.col("role") == "system"
    review = F.struct(
        F.when(~system, said).otherwise(no_text).alias("text"),
        F.when(system, said).otherwise(no_text).alias("originalText"),
        F.when(F.col("turn") != 6, (1 + F.col("turn") % 5).cast("string")).alias("rating"),
        F.struct(F.when(F.col("role") == "user", F.concat(F.lit("author "), F.col("conv_id")))
                 .alias("displayName"),
                 F.when(F.col("role") != "user", F.lit("https://maps.example/a")).alias("uri"))
         .alias("authorAttribution"),
        F.when(F.col("turn") < 2, "a week ago").alias("relativePublishTimeDescription"),
        F.lit("2024-05-01T00:00:00Z").alias("publishTime"))
    name = F.when(F.col("conv_id") % 4 != 3,
                  F.struct(F.concat(F.lit("Place "), F.col("conv_id")).alias("text")))
    body = F.struct(
        F.concat(F.lit("place_"), F.col("conv_id")).alias("id"), name.alias("displayName"),
        F.when(F.col("conv_id") % 2 == 0, "1 Main St").alias("formattedAddress"),
        (3 + F.col("conv_id") % 3 / 2).alias("rating"),
        F.col("conv_id").cast("int").alias("userRatingCount"), F.array(review).alias("reviews"))
    return c.select(F.to_json(body).alias("body"))


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search payload per customer; the nation is the query."""
    c = table(spark, sf_dir, "customer")
    place = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.struct(F.col("c_name").alias("text")))
         .alias("displayName"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("formattedAddress"),
        F.when(F.col("c_acctbal") > 1000, F.lit(7)).alias("userRatingCount"))
    return c.select(F.col("c_nationkey").cast("string").alias("query"),
                    F.to_json(F.struct(F.array(place).alias("places"))).alias("body"))


def event_log(events: DataFrame) -> DataFrame:
    """Events as a prediction log."""
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("rev_"), F.col("event_id").cast("string")).alias("review_id"),
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative")
         .otherwise("neutral").alias("sentiment"),
        F.col("ts").cast("timestamp").alias("timestamp"))


def stored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as stored reviews, line items as their predictions."""
    reviews = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("P"), F.col("o_custkey") % 50))
         .alias("product"))
    predictions = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"),
        F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "neutral")
         .otherwise("positive").alias("sentiment"),
        F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        pick(labels.MODELS, F.col("l_linenumber") % 3).alias("model_used"))
    return reviews, predictions


def _term_rates(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, Column, list[Column]]:
    """The ``size`` words in most documents with ``term, df``; columns for their idf and
    coefficients: log document rate of a word in a class over its log rate overall."""
    prepared = etl.preprocess(labelled_texts(spark, sf_dir), "row_order")
    prepared = materialise(prepared.select("sentiment", "clean_text"), "term-rates")  # counted twice
    words = (prepared.select("sentiment", F.array_distinct(tx.words(F.col("clean_text"))).alias("w"))
             .select("sentiment", F.explode("w").alias("term")))
    found = (words.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                       *labels.class_counts(F.col("sentiment")))
             .orderBy(F.col("df").desc(), F.col("term").asc()).limit(size))
    sizes = prepared.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                  *labels.class_counts(F.col("sentiment"))).alias("s")).scalar()
    overall = F.log((F.col("df") + 1) / (sizes["n"] + 2))
    coefs = [F.round(F.log((F.col(c) + 1) / (sizes[c] + 2)) - overall, 6) for c in LABELS]
    return found, F.round(F.log((sizes["n"] + 1) / (F.col("df") + 1)) + 1, 6), coefs


def stand_in_coefficients(spark: SparkSession, sf_dir: str, size: int = 10_000) -> DataFrame:
    """``(class, term, coef)`` that SQL can also compute."""
    found, _, coefs = _term_rates(spark, sf_dir, size)
    return found.select("term", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), w.alias("coef")) for c, w in zip(LABELS, coefs)]))
    ).select("class", "term", "coef")


# Stand-in models: name, factor of the coefficients, intercepts by class.
STAND_INS = (("logistic_regression", 4.0, (0.1, 0.0, -0.1)),
             ("balanced_logistic_regression", 6.0, (0.0, 0.3, 0.05)),
             ("linearsvc", 0.5, (-0.25, -0.1, -0.3)))


def stand_in_models(spark: SparkSession, sf_dir: str, size: int = 10_000) -> linear.LinearModels:
    """The stand-in coefficients as three stored models."""
    found, idf, coefs = _term_rates(spark, sf_dir, size)
    lines = [F.round(w * factor, 6) for _, factor, _ in STAND_INS for w in coefs]
    heads = tuple(linear.Head(name, name != "linearsvc", bias) for name, _, bias in STAND_INS)
    return linear.LinearModels(found.select("term", idf.alias("idf"), F.array(*lines).alias("coefs")), heads)
