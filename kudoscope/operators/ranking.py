"""Top-k per group and exact quotas, without ranking a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kudoscope.schemas import LABELS

# Hash shards in which a group is cut first: what all partitions keep of one hot
# group adds up, and would meet in one task.
SHARDS = 64


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  unique: str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, with their rank; ``unique`` breaks ties.

    ``row_number() <= k`` is planned as a group limit before and after the
    shuffle, so no partition sends more than k rows of a group.
    """
    order = [*order, F.col(unique).asc()]
    shards = Window.partitionBy(*keys, "_shard").orderBy(*order)
    df = (df.withColumn("_shard", F.pmod(F.xxhash64(unique), F.lit(SHARDS)))
          .withColumn(rank, F.row_number().over(shards))
          .filter(F.col(rank) <= k).drop("_shard", rank))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def draw_hash(unique: Column, seed: int) -> Column:
    """A uniform, repeatable draw per row: 32 hex digits that sort like a number."""
    return F.md5(F.concat_ws("_", unique.cast("string"), F.lit(str(seed))))


def below_rate(draw: Column, rate: float) -> Column:
    """True for a ``rate`` share of the draws; compares hex prefixes, no arithmetic."""
    if rate >= 1.0:
        return F.lit(True)
    return F.substring(draw, 1, 8) < F.lit(format(int(rate * 2 ** 32), "08x"))


def smallest_draws(df: DataFrame, stratum: str, draw: str, quotas: DataFrame) -> DataFrame:
    """Per stratum, the draw of the last row inside its quota: ``(stratum, cut)``.

    Counts draws by their first four hex digits, walks that small histogram to the
    bucket in which the quota ends, and ranks only the rows of this one bucket
    (1/65,536 of a stratum). No task ever ranks a whole class.

    ``quotas`` has columns ``stratum, quota``; strata are the fixed sentiment
    classes, which is what bounds the broadcasts to three rows.
    """
    rows = (df.filter(F.col(stratum).isin(*LABELS))
            .select(F.col(stratum).alias("stratum"), F.col(draw).alias("draw"))
            .withColumn("bucket", F.substring("draw", 1, 4)))
    walk = Window.partitionBy("stratum").orderBy("bucket")
    histogram = (rows.groupBy("stratum", "bucket").count()
                 .withColumn("upto", F.sum("count").over(walk))
                 .withColumn("size", F.sum("count").over(Window.partitionBy("stratum")))
                 .withColumn("before", F.col("upto") - F.col("count")))
    edge = (histogram.join(F.broadcast(quotas), "stratum")
            .withColumn("quota", F.least("quota", "size"))
            .filter((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("upto")))
            .select("stratum", "bucket", (F.col("quota") - F.col("before")).alias("left")))
    in_edge = Window.partitionBy("stratum").orderBy("draw")
    return (rows.join(F.broadcast(edge), ["stratum", "bucket"])
            .withColumn("nth", F.row_number().over(in_edge))
            .filter(F.col("nth") == F.col("left"))
            .select("stratum", F.col("draw").alias("cut")))


def flag_quota(df: DataFrame, stratum: str, unique: str, seed: int, quotas: DataFrame,
               flag: str = "chosen") -> DataFrame:
    """Add ``flag``: the row is among its stratum's ``quota`` smallest draws.

    Exact counts per stratum; the wide rows are never shuffled. A quota at or
    above the size of its stratum takes the whole stratum.
    """
    drawn = df.withColumn("_draw", draw_hash(F.col(unique), seed))
    cuts = smallest_draws(drawn, stratum, "_draw", quotas)
    return (drawn.join(F.broadcast(cuts), F.col(stratum) == F.col("stratum"), "left")
            .withColumn(flag, F.coalesce(F.col("_draw") <= F.col("cut"), F.lit(False)))
            .drop("stratum", "cut", "_draw"))
