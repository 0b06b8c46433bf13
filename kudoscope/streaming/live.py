"""Live operators: the batch functions on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from kudoscope.functions.labels import DEFAULT_MODEL, share_pct
from kudoscope.functions.rules import with_intelligence
from kudoscope.operators import models

# Micro-batches after which the window table is written whole.
SNAPSHOT_EVERY = 20


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet files landing in ``folder``, which may be a glob over files and folders."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def tag_stream(reviews: DataFrame, partitions: int | None = None) -> DataFrame:
    """Stateless tagging of arriving reviews; the same function as in batch.

    ``partitions`` spreads micro-batches that hold only a few large files.
    """
    return with_intelligence(reviews.repartition(partitions) if partitions else reviews)


def score_stream(reviews: DataFrame, artifacts: models.Artifacts, model: str = DEFAULT_MODEL,
                 partitions: int | None = None) -> DataFrame:
    """Arriving reviews scored by fitted pipelines and tagged by the label they got; stateless."""
    reviews = reviews.repartition(partitions) if partitions else reviews
    return with_intelligence(models.score(reviews, artifacts, model))


def dedup_log_stream(log: DataFrame, key: str = "review_id", stamp: str = "timestamp",
                     delay: str = "1 hour") -> DataFrame:
    """Each key once. State is dropped behind the watermark, so a repeat that comes
    later than ``delay`` is admitted again."""
    return (log.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
            .dropDuplicatesWithinWatermark([key]))


def windowed_ratio_stream(reviews: DataFrame, stamp: str = "timestamp", width: str = "1 day",
                          delay: str = "1 day") -> DataFrame:
    """Reviews and positive share per fixed window."""
    timed = reviews.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    counts = timed.groupBy(F.window(stamp, width)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("sentiment") == "positive")
        .alias("positive"))
    return counts.select(F.col("window.start").alias("window_start"), "total", "positive",
                         F.round(share_pct(F.col("positive"), F.col("total")), 1)
                         .alias("pos_ratio"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to Parquet, stopping when all present input is processed."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_batches(stream: DataFrame, path: str, checkpoint: str,
                   each: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Exactly-once append of ``each`` micro-batch, worked on as a table: joins and aggregates
    in ``each`` see that batch alone and keep no state.

    A batch goes to a folder of its own, which is overwritten if the batch runs again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=number`` in ``path``, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(f.getName().split("=")[1]) for f in found
                  if f.getName().startswith(f"{kind}=") and files.exists(hadoop.Path(f, "_SUCCESS")))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def update_windows(stream: DataFrame, path: str, checkpoint: str, key: str = "window_start",
                   snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Changed windows of each micro-batch, in a folder of the batch's own.

    State ends behind the watermark. A batch that is run again overwrites its own
    folder, so readers never miss a table and never count a batch twice. Every
    ``snapshot_every`` batches the newest state of all windows is written to
    ``path-snapshots``; then the batches and snapshots that the snapshot before holds go.
    A reader that began before two snapshots were made has to start again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % snapshot_every:
            return
        spark, snapshots = batch.sparkSession, f"{path}-snapshots"
        held = [n for n in _written(spark, snapshots, "upto") if n < batch_id]
        newest = _newest(spark, path, batch.schema, key, held[-1] if held else None)
        newest.write.mode("overwrite").parquet(f"{snapshots}/upto={batch_id}")
        if held:
            for n in _written(spark, path, "batch"):
                if n <= held[-1]:
                    _drop(spark, f"{path}/batch={n}")
            for n in held[:-1]:
                _drop(spark, f"{snapshots}/upto={n}")

    return (stream.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _newest(spark: SparkSession, path: str, schema: T.StructType, key: str, upto: int | None) -> DataFrame:
    """The newest state of every window from the snapshot ``upto`` and the batches since."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if upto is not None:
        held = spark.read.schema(schema).parquet(f"{path}-snapshots/upto={upto}")
        rows = rows.filter(F.col("batch") > upto).unionByName(held.withColumn("batch", F.lit(upto).cast("long")))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*schema.names), "batch").alias("_row"))
    return newest.select("_row.*")


def latest_windows(spark: SparkSession, path: str, schema: T.StructType,
                   key: str = "window_start") -> DataFrame:
    """The newest state of every window that ``update_windows`` wrote: the last snapshot and the batches since."""
    held = _written(spark, f"{path}-snapshots", "upto")
    return _newest(spark, path, schema, key, held[-1] if held else None)
