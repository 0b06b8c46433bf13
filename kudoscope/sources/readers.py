"""Readers: raw records, processed tables, pasted and uploaded batches, place payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kudoscope.functions import labels, text as tx
from kudoscope.operators.ranking import top_per_group
from kudoscope.schemas import (PLACE_DETAILS, PLACE_SEARCH, RAW_REVIEW, REVIEW, REVIEW_CSV)

# ---------------------------------------------------------------- fixed values
PLACE_CATEGORY = "Local Business / Places"
PLACE_SOURCE = "google_places_api"
UNKNOWN_PLACE = "Unknown Place"
ANONYMOUS_AUTHOR = "Anonymous Google Reviewer"
SEARCH_LIMIT = 10
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
                "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm")
# ------------------------------------------------------------ end fixed values

_BAD = "_bad"


def _bound(value: Column, body) -> Column:
    """``body(value)``, with a value that is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _typed(raw: Column, kind: T.DataType) -> Column:
    """The JSON text of one value as ``kind``; null where it can't be read as that.

    An object of a single text field may also be a plain string.
    """
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, T.BooleanType):
        return raw.try_cast("boolean")
    if isinstance(kind, T.IntegralType):
        name = kind.simpleString()
        return F.coalesce(raw.try_cast(name), raw.try_cast("double").try_cast(name))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.from_json(raw, T.ArrayType(T.StringType())), lambda e: _typed(e, kind.elementType))
    if isinstance(kind, T.StructType):
        def fields(parsed: Column) -> Column:
            found = F.struct(*[_typed(parsed[f.name], f.dataType).alias(f.name) for f in kind])
            is_object = F.ltrim(raw).startswith("{")
            if len(kind) == 1 and isinstance(kind[0].dataType, T.StringType):
                return F.when(is_object, found).when(raw.isNotNull(), F.struct(raw.alias(kind[0].name)))
            return F.when(is_object, found)
        return _bound(F.from_json(raw, _as_text(kind)), fields)
    return raw.try_cast(kind.simpleString())


def decode_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse a JSON text column; every row stays, with ``decoded`` false where it is no JSON object.

    Values are read as text first and converted one by one: a field of another type
    (a number in quotes, a whole float for an integer) is converted, or null if that
    can't be done, and never costs the record its other fields.
    """
    wide = T.StructType([*_as_text(schema), T.StructField(_BAD, T.StringType())])
    parsed = F.from_json(F.col(column), wide, {"columnNameOfCorruptRecord": _BAD})
    kept = df.withColumn("_r", parsed)
    good = F.col("_r").isNotNull() & F.col(f"_r.{_BAD}").isNull() & F.ltrim(F.col(column)).startswith("{")
    return (kept.select("*", good.alias("decoded"),
                        *[_typed(F.col(f"_r.{f.name}"), f.dataType).alias(f.name) for f in schema]).drop("_r"))


def parse_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse a JSON text column; rows that do not decode are skipped."""
    return decode_json(df, column, schema).filter("decoded").drop("decoded")


def line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """``source_lines, undecodable``: all lines of a JSON-lines source, and those without a record."""
    decoded = decode_json(lines.select(column), column, T.StructType([]))
    return decoded.agg(F.count(F.lit(1)).alias("source_lines"),
                       F.count_if(~F.coalesce("decoded", F.lit(False))).alias("undecodable"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a small input sits in fewer files than there are cores.

    Text rules and cleaning are bound by the processor, so one gzip file or one
    large row group (which is read by one task, whatever the number of splits) must
    not decide the parallelism. An input with two or more splits per core, which is
    every large one, passes through without a shuffle and without listing files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_raw_reviews(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """JSON-lines reviews, also gzipped; undecodable lines are skipped.

    A gzip file is read by one task; name ``partitions`` to spread its rows wider
    than over the cores before any work.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "_line")
    lines = lines.repartition(partitions) if partitions else spread(lines)
    return parse_json(lines.filter(~tx.is_blank(F.col("_line"))), "_line", RAW_REVIEW).drop("_line")


def catalogue_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``product, file, rows`` of an audit written by ``sinks.write_catalogue_audit``."""
    return spark.read.parquet(f"{path}/manifest")


def read_catalogue_audit(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """Audit rows of one product, from the files that hold it, or of the whole catalogue.

    A product lies in neighbouring files, at most as many as the audit has, so their names
    are few. A product that the manifest does not list gives no rows.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if product is None:
        return rows
    held = catalogue_manifest(spark, path).filter(F.col("product") == product).select("file").collect()
    found = spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{r['file']}" for r in held]) if held else rows
    return found.filter(F.col("product") == product)


def source_row_count(lines: DataFrame) -> DataFrame:
    """Number of source rows; feeds the sampling rate."""
    return lines.agg(F.count(F.lit(1)).alias("total_rows"))


def apply_review_defaults(df: DataFrame) -> DataFrame:
    """Typed review columns with the defaults of missing or unreadable values."""
    def text(name: str, default: str | None) -> Column:
        c = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return c if default is None else F.coalesce(c, F.lit(default))

    values = {
        "text": text("text", ""), "title": text("title", ""),
        "rating": F.coalesce(text("rating", None).try_cast("double"), F.lit(5.0)),
        "helpful_votes": F.coalesce(text("helpful_votes", None).try_cast("double").try_cast("int"), F.lit(0)),
        "verified_purchase": F.coalesce(text("verified_purchase", None).try_cast("boolean"),
                                        F.lit(False)),
        "product": text("product", "Unknown"),
        "sentiment": F.lower(text("sentiment", "neutral")),
        "date_dt": F.coalesce(*[F.try_to_timestamp(text("date", None), F.lit(f))
                                for f in DATE_LAYOUTS]),
    }
    return df.withColumns(values)


def load_reviews(spark: SparkSession, path: str, sample_limit: int | None = None,
                 order: str = "review_id", fmt: str = "parquet") -> DataFrame:
    """Processed reviews from Parquet or CSV, as ``fmt`` says, with defaults applied."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt}")
    if fmt == "parquet":
        df = spark.read.schema(REVIEW).parquet(path)
    else:
        df = (spark.read.schema(REVIEW_CSV).option("header", True).option("multiLine", True)
              .option("escape", '"').csv(path))
    if sample_limit is not None:
        df = df.orderBy(order).limit(sample_limit)
    return apply_review_defaults(df)


def uploaded_batch(df: DataFrame, text_col: str) -> DataFrame:
    """One text column of an uploaded table as strings, missing values dropped."""
    return df.select(F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])


def read_batch_csv(spark: SparkSession, path: str, text_col: str) -> DataFrame:
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').csv(path))
    return uploaded_batch(raw, text_col)


def pasted_lines(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per non-blank, trimmed line of a pasted block, in order."""
    return (df.select(*keep, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "_line"))
            .filter(~tx.is_blank(F.col("_line")))
            .select(*keep, "line_no", tx.trim_spaces(F.col("_line")).alias("text")))


# ---------------------------------------------------------------- place payloads
def place_details(df: DataFrame, body: str = "body") -> DataFrame:
    """Place fields and the untouched review array of each details payload."""
    parsed = parse_json(df.select(body), body, PLACE_DETAILS)
    return parsed.select(
        F.col("id").alias("place_id"),
        F.coalesce("displayName.text", F.lit(UNKNOWN_PLACE)).alias("name"),
        F.coalesce("formattedAddress", F.lit("")).alias("address"), "rating",
        F.coalesce("userRatingCount", F.lit(0)).alias("user_rating_count"),
        F.coalesce("googleMapsUri", F.lit("")).alias("maps_uri"), "reviews")


def flatten_place_reviews(places: DataFrame) -> DataFrame:
    """One row per review of each payload, still in payload shape."""
    return places.select("place_id", "name", "maps_uri", F.explode("reviews").alias("review"))


def unified_place_reviews(places: DataFrame) -> DataFrame:
    """Payload reviews in the unified schema, before scoring; reviews without text skipped."""
    r = F.col("review")

    def filled(path: str, default: str) -> Column:
        return F.coalesce(F.col(f"review.{path}"), F.lit(default))

    # the first text object with a text is used, even when that is empty; an object
    # without any counts as missing
    body = F.when(r["text"]["text"].isNotNull(), r["text"]["text"]).otherwise(r["originalText"]["text"])
    when = F.coalesce(F.nullif(F.col("review.relativePublishTimeDescription"), F.lit("")),
                      F.col("review.publishTime"), F.lit(""))
    flat = flatten_place_reviews(places).select(
        "place_id", tx.trim_spaces(F.coalesce(body, F.lit(""))).alias("text"),
        F.coalesce(r["rating"].try_cast("double"), F.lit(5.0)).alias("rating"),
        F.col("name").alias("product"), when.alias("date"),
        filled("authorAttribution.displayName", ANONYMOUS_AUTHOR).alias("author_name"),
        filled("authorAttribution.uri", "").alias("author_uri"),
        filled("authorAttribution.photoUri", "").alias("author_photo_uri"),
        F.col("maps_uri").alias("google_maps_uri"))
    return flat.filter(F.col("text") != "").select(
        tx.place_review_id(F.col("place_id"), F.col("author_name"), F.col("text"))
          .alias("review_id"),
        "place_id", "text", F.lit("").alias("title"), "rating", "product",
        F.lit(PLACE_CATEGORY).alias("category"), F.lit("").alias("price"), "date",
        F.lit(0).alias("helpful_votes"), F.lit(False).alias("verified_purchase"),
        F.lit(PLACE_SOURCE).alias("source"), "author_name", "author_uri", "author_photo_uri",
        "google_maps_uri")


def place_search(df: DataFrame, query: str = "query", body: str = "body",
                 limit: int = SEARCH_LIMIT) -> DataFrame:
    """Found places of each search payload, at most ``limit`` per query."""
    parsed = parse_json(df, body, PLACE_SEARCH).select(
        query, F.posexplode("places").alias("position", "p"))
    flat = parsed.select(
        query, "position", F.col("p.id").alias("place_id"),
        F.coalesce("p.displayName.text", F.lit(UNKNOWN_PLACE)).alias("name"),
        F.coalesce("p.formattedAddress", F.lit("")).alias("address"),
        F.col("p.rating").alias("rating"),
        F.coalesce("p.userRatingCount", F.lit(0)).alias("user_rating_count"),
        F.coalesce("p.googleMapsUri", F.lit("")).alias("maps_uri"))
    return top_per_group(flat, [query], [F.col("position").asc()], limit, "place_id")


def response_class(status: Column, details: bool = True) -> Column:
    """``struct(success, error)`` of a landed response status."""
    error = (F.when(status == 200, F.lit(None).cast("string"))
             .when(status.isin(400, 401, 403), "AUTHENTICATION_OR_PERMISSION_ERROR"))
    if details:
        error = error.when(status == 404, "INVALID_PLACE_ID")
    error = (error.when(status == 429, "QUOTA_EXCEEDED")
             .otherwise("DETAILS_FETCH_FAILED" if details else "API_ERROR"))
    return F.struct((status == 200).alias("success"), error.alias("error"))


def with_mismatch(df: DataFrame) -> DataFrame:
    return df.withColumn("is_mismatch", labels.is_mismatch(F.col("rating"), F.col("sentiment")))
