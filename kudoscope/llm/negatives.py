"""Hard negatives by a secondary sort: one stream of scores per anchor, best first.

Anchors and rows are cut into blocks; a task scores one block of anchors against one block
of rows. A score travels as a key packed of (anchor, descending score, kind, id), big-endian
and without signs, so that bytes sort as the numbers do. ``repartitionAndSortWithinPartitions``
brings the keys of an anchor together in that order, and an iterator reads them once: it
holds the open windows of one anchor and nothing else.

The sort runs twice. First a block sends the best scores of an anchor's own label, and the
stream's first are its positives. Then a block sends, for each window that a positive opens,
its best scores in there, and the positives' own keys open the windows in the stream. What a
block holds back could not be among the first of any window, so nothing is lost by it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.llm import common
from kudoscope.session import materialise

SCALE = 256             # a component x counts as floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)       # per cent of the positive's score
ANCHOR_BLOCK = 2048
ROW_BLOCK = 4096
KEY = struct.Struct(">QQQBQQ")   # anchor, its mark, descending score, kind, id, its mark
_TOP = 1 << 63
_MOST = _TOP - 1


def percent(score, share: int):
    """``floor(share * score / 100)``, without a product that leaves 64 bits."""
    return score // 100 * share + score % 100 * share // 100


def window_of(score, window: tuple[int, int] = WINDOW):
    """Least and greatest negative score that a positive of this score admits."""
    return -percent(-score, window[0]), percent(score, window[1])


def pack(anchor, anchor_mark, score, kind, row, row_mark) -> bytes:
    """Keys of ``KEY``, one after the other; all arguments but ``kind`` are arrays of signed longs."""
    def unsigned(x):
        return (np.asarray(x, dtype=np.int64).view(np.uint64) ^ np.uint64(_TOP)).astype(">u8")

    out = np.empty(len(anchor), dtype=[("a", ">u8"), ("m", ">u8"), ("s", ">u8"), ("k", "u1"), ("r", ">u8"), ("n", ">u8")])
    out["a"], out["m"], out["k"] = unsigned(anchor), unsigned(anchor_mark), kind
    out["s"] = ~unsigned(score).astype(np.uint64)
    out["r"], out["n"] = unsigned(row), unsigned(row_mark)
    return out.tobytes()


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, mark, score, kind, row, row_mark = KEY.unpack(key)
    return anchor - _TOP, mark - _TOP, _MOST - score, kind, row - _TOP, row_mark - _TOP


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond 64 bits the nearest long."""
    def longest(x):
        return np.sqrt((x * x).sum(axis=1).max(initial=0))

    if longest(anchors) * longest(rows) < 2 ** 52:
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape) for x in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, -_TOP, _MOST).astype(np.int64)


def _vectors(table: pa.Table, scale: int) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values.reshape(len(column), -1)) if len(values) else np.zeros((len(column), 0))


def _parts(anchors: pa.Table, rows: pa.Table, scale: int):
    """Scores of some anchors at a time; rows by ascending id, so that the first of equals comes first."""
    rows = rows.sort_by([("vec_id", "ascending"), ("mark", "ascending")])
    x, y = _vectors(anchors, scale), _vectors(rows, scale)
    ids, marks, labels = (rows.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
    for at in range(0, len(x), 256):
        some = anchors.slice(at, 256)
        own = {c: some.column(c).to_numpy() for c in ("vec_id", "mark", "label")}
        same = own["label"][:, None] == labels[None, :]
        self_ = (own["vec_id"][:, None] == ids[None, :]) & (own["mark"][:, None] == marks[None, :])
        yield some, own, products(x[at:at + 256], y), same, self_, ids, marks


def _best(scores: np.ndarray, admitted: np.ndarray, count: int):
    """Positions of the ``count`` best admitted scores of each line, ties by position."""
    least = np.iinfo(np.int64).min
    open_ = admitted.copy()
    for _ in range(count):
        lines = np.flatnonzero(open_.any(axis=1))
        if not len(lines):
            return
        at = np.where(open_[lines], scores[lines], least)
        best = at.argmax(axis=1)
        # a true score may be the least long; then the first admitted is meant
        best = np.where(open_[lines, best], best, open_[lines].argmax(axis=1))
        open_[lines, best] = False
        yield lines, best


def _keys(found: list[bytes]) -> pa.Table:
    keys = {raw[i:i + KEY.size] for raw in found for i in range(0, len(raw), KEY.size)}
    return pa.table({"key": pa.array(keys, pa.binary())})


def _own_label(scale: int, positives: int):
    def score(anchors, rows):
        found = []
        for _, own, s, same, self_, ids, marks in _parts(anchors, rows, scale):
            for a, r in _best(s, same & ~self_, positives):
                found.append(pack(own["vec_id"][a], own["mark"][a], s[a, r], 0, ids[r], marks[r]))
        return _keys(found)
    return score


def _in_windows(scale: int, positives: int, negatives: int, window: tuple[int, int]):
    def score(anchors, rows):
        found = []
        for some, own, s, same, _, ids, marks in _parts(anchors, rows, scale):
            opened = some.column("scores").to_pylist()
            for nth in range(positives):
                has = np.array([len(p) > nth for p in opened])
                low, high = window_of(np.array([p[nth] if len(p) > nth else 0 for p in opened], dtype=np.int64), window)
                fits = (s >= low[:, None]) & (s <= high[:, None]) & ~same & has[:, None]
                for a, r in _best(s, fits, negatives):
                    found.append(pack(own["vec_id"][a], own["mark"][a], s[a, r], 1, ids[r], marks[r]))
        return _keys(found)
    return score


def _cells(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, score) -> DataFrame:
    """``key`` rows of every block of anchors met with every block of rows."""
    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int")

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    cell = ["dim", "anchor_block", "row_block"]
    # named anew, since both sides come from one table
    left = (anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
            .withColumns({"anchor_block": block(anchor_blocks), "row_block": all_of(row_blocks)}))
    right = rows.withColumns({"row_block": block(row_blocks), "anchor_block": all_of(anchor_blocks)})
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(score, "key binary")


def _sorted(keys: DataFrame) -> RDD:
    """All keys, those of an anchor in one partition and in order."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (keys.rdd.map(lambda r: (bytes(r[0]), None))
            .repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16])))


def _first_positives(count: int):
    def read(stream):
        anchor, seen = None, 0
        for key, _ in stream:
            if key[:16] != anchor:
                anchor, seen = key[:16], 0
            seen += 1
            if seen <= count:
                a, mark, score, _, row, row_mark = unpack(key)
                yield a, mark, seen, row, row_mark, score, bytearray(key)
    return read


def _negatives(count: int, window: tuple[int, int]):
    """Reads the keys of an anchor once. A positive opens a window; it closes below its least
    score or when it has its negatives."""
    def read(stream):
        anchor, windows = None, []
        for key, _ in stream:
            if key[:16] != anchor:
                anchor, windows = key[:16], []
            a, _, score, kind, row, _ = unpack(key)
            if kind == 0:
                windows.append([row, score, *window_of(score, window), 0])
                continue
            windows = [w for w in windows if w[2] <= score and w[4] < count]
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    yield a, w[0], w[4], row, w[1], score
    return read


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has vec_id, embedding, label; ``anchors`` is the condition on them that makes
    a row an anchor. Higher scores come first, ties by smaller vec_id. For each of an anchor's
    first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose
    score is ``window`` per cent of the positive's. A positive of negative score admits none.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part.
    Rows alike in all three columns count once; rows that share a vec_id otherwise are rows of
    their own, and anchors too. Vectors of different lengths have no score. Scores beyond 64
    bits are the nearest long. Extra columns are not read; an empty table gives none.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                           F.col("label").cast("long").alias("label"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
            .withColumns({"dim": F.size("embedding"), "mark": F.xxhash64("label", "embedding")})
            .dropDuplicates(["vec_id", "label", "embedding"]))
    rows = materialise(rows, "negatives-rows")
    chosen = rows.filter(anchors)
    blocks = -(-max(chosen.count(), 1) // ANCHOR_BLOCK), -(-max(rows.count(), 1) // ROW_BLOCK)
    spark = vectors.sparkSession
    best = _sorted(_cells(chosen, rows, *blocks, _own_label(scale, positives))).mapPartitions(
        _first_positives(positives))
    best = materialise(spark.createDataFrame(
        best, "anchor long, mark long, nth int, row long, row_mark long, score long, key binary"), "negatives-positives")
    # at most `positives` scores an anchor
    scores = best.groupBy(F.col("anchor").alias("vec_id"), "mark").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "score"))), lambda p: p["score"]).alias("scores"))
    opened = chosen.join(scores, ["vec_id", "mark"])
    keys = _cells(opened, rows, *blocks, _in_windows(scale, positives, negatives, window))
    found = _sorted(keys.unionByName(best.select("key"))).mapPartitions(_negatives(negatives, window))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for every 50th vector; every 7th bears the label after its own."""
    vectors = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)
