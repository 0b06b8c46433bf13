"""Declared schemas of every table the package reads or writes."""

from pyspark.sql import types as T

# The three sentiment classes in report order.
LABELS = ("negative", "neutral", "positive")

RAW_REVIEW = T.StructType([
    T.StructField("rating", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("helpful_vote", T.IntegerType()),
    T.StructField("verified_purchase", T.BooleanType()),
])

REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("product", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("helpful_votes", T.IntegerType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("clean_text", T.StringType()),
])

# A CSV of processed reviews is read as text first, so that one bad number
# turns into a default instead of failing or nulling the row.
REVIEW_CSV = T.StructType([T.StructField(f.name, T.StringType()) for f in REVIEW])

_TEXT = T.StructType([T.StructField("text", T.StringType())])

PLACE_REVIEW = T.StructType([
    T.StructField("text", _TEXT),
    T.StructField("originalText", _TEXT),
    T.StructField("rating", T.StringType()),
    T.StructField("authorAttribution", T.StructType([
        T.StructField("displayName", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("photoUri", T.StringType()),
    ])),
    T.StructField("relativePublishTimeDescription", T.StringType()),
    T.StructField("publishTime", T.StringType()),
])

PLACE_DETAILS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("displayName", _TEXT),
    T.StructField("formattedAddress", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("userRatingCount", T.IntegerType()),
    T.StructField("googleMapsUri", T.StringType()),
    T.StructField("reviews", T.ArrayType(PLACE_REVIEW)),
])

PLACE_SEARCH = T.StructType([
    T.StructField("places", T.ArrayType(T.StructType(
        [f for f in PLACE_DETAILS if f.name != "reviews"]))),
])

STORED_REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

PREDICTION = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("review_id", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model_requested", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

METRIC = T.StructType(
    [T.StructField("model_name", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "accuracy", "precision", "recall", "macro_precision", "macro_recall",
        "f1", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1",
        "latency")]
    + [T.StructField("evaluated_at", T.TimestampType())]
)
