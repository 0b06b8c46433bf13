"""Stratified splits and samples with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kudoscope.functions.labels import class_counts
from kudoscope.operators.ranking import draw_hash, flag_quota
from kudoscope.schemas import LABELS

SEED = 42
_WIDE = "decimal(19,0)"     # products of two row counts do not fit a bigint


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    sizes = df.agg(*class_counts(F.col(label)))
    return sizes.select(
        sum((F.col(c) for c in LABELS), F.lit(0)).alias("n"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("stratum"), F.col(c).alias("size"))
                           for c in LABELS]))).filter(F.col("size") > 0)


def split_quotas(df: DataFrame, label: str = "sentiment", test_share: float = 0.2) -> DataFrame:
    """Test rows per class: the whole test set has ceil(share * N) rows.

    The training total is dealt out in proportion to class size, largest
    remainder first (class name breaks ties); the rest of each class is test.
    """
    sizes = _class_sizes(df, label).withColumn(
        "n_train", F.col("n") - F.ceil(F.round(F.col("n") * test_share, 6)))
    product = F.col("size").cast(_WIDE) * F.col("n_train").cast(_WIDE)
    rest = product % F.col("n").cast(_WIDE)
    dealt = sizes.withColumns({
        "base": ((product - rest) / F.col("n")).cast("bigint"),     # exact: no remainder left
        "rest": rest.cast("bigint")})
    everything = Window.partitionBy()                       # three rows at most
    by_rest = Window.orderBy(F.col("rest").desc(), F.col("stratum").asc())
    extra = F.col("n_train") - F.sum("base").over(everything)
    train = F.col("base") + (F.row_number().over(by_rest) <= extra).cast("bigint")
    return dealt.select("stratum", (F.col("size") - train).alias("quota"))


def stratified_split(df: DataFrame, unique: str = "review_id", label: str = "sentiment",
                     test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test``. Membership depends on the id and seed only, so it can be re-derived."""
    return flag_quota(df, label, unique, seed, split_quotas(df, label, test_share), "is_test")


def sample_quotas(df: DataFrame, n: int, label: str = "sentiment") -> DataFrame:
    """Rows per class of a sample of ``n``: max(1, round(n * class share)).

    When rounding up exceeds ``n``, the caller's final ``limit`` trims the sample.
    """
    sizes = _class_sizes(df, label)
    wanted = F.least(F.lit(n), F.col("n"))
    return sizes.select("stratum", F.greatest(
        F.lit(1), F.bround(wanted * F.col("size") / F.col("n"), 0)).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, n: int = 200, unique: str = "review_id",
                      label: str = "sentiment", seed: int = SEED) -> DataFrame:
    """``n`` rows in class proportion, in random but repeatable order."""
    chosen = flag_quota(df, label, unique, seed, sample_quotas(df, n, label)).filter("chosen")
    return chosen.drop("chosen").orderBy(draw_hash(F.col(unique), seed), unique).limit(n)


def split_leakage(split: DataFrame, text: str = "clean_text") -> DataFrame:
    """Number of distinct test texts that also occur in training; must be 0.

    One pass: texts are told apart by their SHA-256, and each says on which sides it is.
    """
    sides = split.groupBy(F.sha2(text, 256).alias("_print")).agg(
        F.bool_or("is_test").alias("_test"), F.bool_or(~F.col("is_test")).alias("_train"))
    return sides.agg(F.count_if(F.col("_test") & F.col("_train")).alias("overlap"))
