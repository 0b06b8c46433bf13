"""What several operators share: words, prefix sums without large groups, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Rows up to which a table may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
# White space of the word rule: tab to carriage return, and space.
SPACE = "\\x09-\\x0D\\x20"
_TRIM = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array for null or blank text."""
    trimmed = F.btrim(text, F.lit(_TRIM))
    return (F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+"))
            .otherwise(F.array().cast("array<string>")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Key of a text beside its doc_id, so that rows which share an id stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it in a loop."""
    return F.get(F.transform(F.array(value), body), 0)


def sums_before(numbers: Column) -> Column:
    """For each element the sum of those before it; empty for an empty array.

    Works in blocks of about the square root of the length, since appending to an
    array copies it.
    """
    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(values: Column) -> Column:
        n = F.size(values)
        width = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
                             lambda b: running(F.slice(values, b * width + 1, width)))
        found = let(blocks, lambda inner: let(
            running(F.transform(inner, lambda p: F.element_at(p, -1))),
            lambda outer: F.flatten(F.transform(inner, lambda p, i: F.transform(
                F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(outer, i))))))
        return F.when(n > 0, found).otherwise(F.array().cast("array<int>"))

    return let(numbers, sums)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def prefix_sums(df: DataFrame, keys: list[str], coarse: str, fine: str, order: list[str],
                value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of a key before this one.

    ``fine`` cuts the order of a key into runs of bounded size and ``coarse`` cuts
    the runs into bounded numbers, both ascending with the order. No window ever
    holds a whole key, so a key with a third of all rows costs no more than others.
    """
    def before(*part: str):
        return Window.partitionBy(*part)

    def exclusive(column: str, window) -> Column:
        return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(column)

    runs = df.groupBy(*keys, coarse, fine).agg(F.sum(value).alias("_run"))
    blocks = runs.groupBy(*keys, coarse).agg(F.sum("_run").alias("_block"))
    blocks = blocks.withColumn("_before_block", exclusive("_block", before(*keys).orderBy(coarse)))
    runs = (runs.withColumn("_before_run", exclusive("_run", before(*keys, coarse).orderBy(fine)))
            .join(blocks.drop("_block"), [*keys, coarse]).drop("_run", coarse))
    rows = df.withColumn("_within", exclusive(value, before(*keys, fine).orderBy(*order)))
    return (rows.join(runs, [*keys, fine])
            .withColumn(out, F.col("_before_block") + F.col("_before_run") + F.col("_within"))
            .drop("_before_block", "_before_run", "_within"))


def run_bits(rows: int, per_run: int = 256) -> int:
    """Bits of a uniform hash that cut ``rows`` rows into runs of about ``per_run``."""
    return max(2, min(40, (max(rows, 1) // per_run).bit_length()))
