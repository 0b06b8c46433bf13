"""Streams: equal to batch, repeats dropped, late rows excluded."""

import datetime as dt
import re

from conftest import SF, rows
from pyspark.sql import functions as F

from kudoscope.functions.rules import with_intelligence
from kudoscope.plans.queries import QUERIES
from kudoscope.streaming import live

REVIEW = "row_order long, text string, sentiment string, rating double"
LOG = "review_id string, sentiment string, timestamp timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def land(spark, folder, name, data, schema):
    """One file per landing, written under its own name so that file order is landing order."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def drain(stream, tmp_path, schema, spark, name="run"):
    live.append_to(stream, f"{tmp_path}/{name}/rows", f"{tmp_path}/{name}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{tmp_path}/{name}/rows")


def test_tagging_equals_batch(spark, tmp_path):
    data = [(i, t, "negative", 1.0) for i, t in enumerate(
        ["late", "pump broke", "nice", "rash on my arm", "great price", ""])]
    land(spark, tmp_path / "in", "a", data[:3], REVIEW)
    land(spark, tmp_path / "in", "b", data[3:], REVIEW)
    schema = spark.createDataFrame([], REVIEW).schema
    stream = live.file_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    tagged = live.tag_stream(stream, 2)
    got = drain(tagged, tmp_path, tagged.schema, spark)
    want = with_intelligence(spark.createDataFrame(data, REVIEW))
    assert rows(got) == rows(want)
    # restarting on the same checkpoint adds nothing
    assert drain(tagged, tmp_path, tagged.schema, spark).count() == len(data)


def test_repeats_are_logged_once(spark, tmp_path):
    first = [(f"r{i}", "positive", at(1, i)) for i in range(10)]
    land(spark, tmp_path / "in", "a", first + first[:4], LOG)
    land(spark, tmp_path / "in", "b", first[5:] + [("new", "neutral", at(1, 10))], LOG)
    schema = spark.createDataFrame([], LOG).schema
    stream = live.file_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    once = live.dedup_log_stream(stream, delay="1 day")
    got = drain(once, tmp_path, once.schema, spark)
    assert got.count() == 11 == got.select("review_id").distinct().count()


def test_windows_and_late_rows(spark, tmp_path):
    land(spark, tmp_path / "in", "a", [("a", "positive", at(1)), ("b", "negative", at(1, 5)),
                                       ("c", "positive", at(2)), ("d", "positive", at(9))], LOG)
    schema = spark.createDataFrame([], LOG).schema

    def run():
        stream = live.file_stream(spark, f"{tmp_path}/in/*", schema)
        ratio = live.windowed_ratio_stream(stream)
        return rows(drain(ratio, tmp_path, ratio.schema, spark)
                    .select(F.dayofmonth("window_start"), "total", "positive", "pos_ratio"))

    closed = [(1, 2, 1, 50.0), (2, 1, 1, 100.0)]
    assert run() == closed                      # the 9th is still open behind the watermark
    land(spark, tmp_path / "in", "b", [("late", "positive", at(1, 6))], LOG)
    assert run() == closed                      # a row older than the watermark is dropped


def test_update_mode_keeps_open_windows(spark, tmp_path):
    land(spark, tmp_path / "in", "a", [("a", "positive", at(1)), ("d", "negative", at(9))], LOG)
    schema = spark.createDataFrame([], LOG).schema
    ratio = live.windowed_ratio_stream(live.file_stream(spark, f"{tmp_path}/in/*", schema))

    def run():
        live.update_windows(ratio, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got = live.latest_windows(spark, f"{tmp_path}/out", ratio.schema)
        return rows(got.select(F.dayofmonth("window_start"), "total"))

    assert run() == [(1, 1), (9, 1)]
    land(spark, tmp_path / "in", "b", [("e", "positive", at(9))], LOG)
    assert run() == [(1, 1), (9, 2)]


def test_window_snapshots(spark, tmp_path):
    """Snapshots bound the folders that are kept and read; rows stay those of all batches."""
    days = [*range(1, 12)]
    for i, day in enumerate(days):
        land(spark, tmp_path / "in", f"f{i:02d}", [(f"r{i}", "positive", at(day)), (f"s{i}", "negative", at(9))], LOG)
    schema = spark.createDataFrame([], LOG).schema
    stream = live.file_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    ratio = live.windowed_ratio_stream(stream, delay="60 days")

    def run():
        live.update_windows(ratio, f"{tmp_path}/out", f"{tmp_path}/state", snapshot_every=3).awaitTermination()
        return live.latest_windows(spark, f"{tmp_path}/out", ratio.schema)

    want = sorted((d, 12 if d == 9 else 1) for d in days)
    got = run()
    assert rows(got.select(F.dayofmonth("window_start"), F.col("total").cast("int"))) == sorted(want, key=repr)
    held = live._written(spark, f"{tmp_path}/out-snapshots", "upto")
    kept = live._written(spark, f"{tmp_path}/out", "batch")
    assert len(held) == 2 and (held[-1] + 1) % 3 == 0
    assert kept[0] == held[0] + 1 and len(kept) <= 2 * 3
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*\(batch#\d+L? > {held[-1]}\)", scan)  # folders before are not opened
    # a snapshot that was not finished is not read
    (tmp_path / "out-snapshots" / "upto=99").mkdir()
    land(spark, tmp_path / "in", "g", [("late", "positive", at(2))], LOG)
    again = run().select(F.dayofmonth("window_start"), F.col("total").cast("int"))
    assert dict(rows(again))[2] == 2 and dict(rows(again))[9] == 12


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be a folder of part files: every row of every file arrives."""
    for name in ("documents", "labels", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_score", "stream_log_dedup", "stream_windowed_ratio"):
        got, want = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, SF)
        assert rows(got) == rows(want) and got.count() > 0
