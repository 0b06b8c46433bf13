"""Connected components of an edge table, on Spark from first to last."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kudoscope.session import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the smallest node around: the larger ones, or the rest.

    The smallest neighbour comes from an aggregate and goes back by a join, so the
    neighbours of a hub are never gathered in one row or one task.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    met = sides.join(low, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node.

    Alternates large and small stars until a pass changes nothing; each pass is a
    written table, so a lost executor costs one pass at most. Nodes without an edge
    do not appear; loops are ignored.
    """
    edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:
        edges = materialise(_stars(_stars(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
