"""Sinks. Every writer is one distributed write; none collects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from kudoscope.operators import analytics, store
from kudoscope.operators.models import Artifacts


def write_reviews(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Processed table as Parquet (default) or CSV."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_summary(reviews: DataFrame, path: str, funnel: DataFrame | None = None) -> None:
    """Dataset summary as one nested JSON document: distributions and funnel counters."""
    entries = store.distribution_entries(reviews)
    if funnel is not None:
        entries = entries.unionByName(store.funnel_entries(funnel))
    store.bundle(entries).coalesce(1).write.mode("overwrite").json(path)


def write_audit_of(df: DataFrame, path: str, products: list[str]) -> None:
    """The audit rows of chosen products as CSV."""
    (analytics.product_audit(df.filter(F.col("product").isin(*products))).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def write_product_audit(df: DataFrame, path: str) -> None:
    """One folder of CSV files per product; for catalogues of some thousand products.

    The rebalance hint gathers small products and splits a hot one over several
    tasks, so a product with a third of all rows is not one giant file.
    """
    (analytics.product_audit(df).hint("rebalance", "product").write.mode("overwrite")
     .option("header", True).option("escape", '"').partitionBy("product").csv(path))


def write_catalogue_audit(df: DataFrame, path: str, files: int = 64, rows_per_file: int = 1_000_000) -> None:
    """The audit of a whole catalogue in ``files`` ranges of products, and a manifest of them.

    The number of files follows ``files`` and the number of rows, not that of products. Rows
    are ranged by product and a hash of all columns of ``df``, its row id among them, so that
    a hot product spreads over several ranges and a repeated task deals rows out as before.
    ``path/manifest`` names per product the files that hold it and their rows; a null product
    is one like any other.
    """
    salted = df.select(F.struct("*").alias("row"), F.xxhash64(*df.columns).alias("salt"))
    rows = analytics.product_audit(df)
    (salted.repartitionByRange(files, "row.product", "salt").select(*[f"row.{c}" for c in rows.columns])
     .sortWithinPartitions("product")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows"))
    written = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    (written.groupBy("product", F.col("_metadata.file_name").alias("file"))
     .agg(F.count(F.lit(1)).alias("rows"))
     .repartitionByRange(max(1, files // 16), "product").sortWithinPartitions("product")
     .write.mode("overwrite").parquet(f"{path}/manifest"))


def write_scored_batch(df: DataFrame, path: str) -> None:
    (df.select("text", "sentiment", "confidence", "model_used").write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def _append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not hold yet; a retried batch adds nothing."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    try:
        held = spark.read.schema(rows.schema).parquet(path).select(key)
        rows = rows.join(held, key, "left_anti")
    except AnalysisException as missing:  # the first batch makes the table
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def append_log(scored: DataFrame, path: str) -> None:
    """Append prediction log rows that are not there yet: one write per batch."""
    _append_new(store.prediction_rows(scored), path, "prediction_id")


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Append the reviews of a batch that are not stored yet."""
    _append_new(store.stored_review_rows(reviews), path, "review_id")


def upsert_metrics(spark: SparkSession, stored_path: str, incoming: DataFrame,
                   target_path: str) -> None:
    """Stored metrics with the incoming ones on top, written to a new folder."""
    stored = spark.read.option("mergeSchema", True).parquet(stored_path)
    store.upsert_metrics(stored, incoming).write.mode("overwrite").parquet(target_path)


def save_artifacts(artifacts: Artifacts, path: str) -> None:
    artifacts.vectoriser.write().overwrite().save(f"{path}/vectoriser")
    for name, model in artifacts.classifiers.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_artifacts(path: str, names: list[str]) -> Artifacts:
    return Artifacts(PipelineModel.load(f"{path}/vectoriser"),
                     {n: PipelineModel.load(f"{path}/{n}") for n in names})


def write_label_info(split: DataFrame, path: str) -> None:
    """Label list, class sizes and split sizes as one JSON row per class."""
    (split.groupBy("sentiment")
     .agg(F.count_if("is_test").alias("test_size"), F.count_if(~F.col("is_test")).alias("train_size"))
     .coalesce(1).write.mode("overwrite").json(path))


def write_evaluation(records: DataFrame, path: str) -> None:
    records.coalesce(1).write.mode("overwrite").json(path)
