"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The fingerprint falls into three segments of 21, 21 and 22 bits, each read as a word
of the (23, 12) Golay code, whose 4,096 codewords stand at least 7 bits apart with a
nearest one within 3 bits of every word. Two segments that differ by at most one bit
share a key: the codeword nearest to one lies within 4 bits of the other. Every word
has one nearest codeword, and one or six within 4 bits.

Three errors over three segments leave either one segment equal and another within
one bit, or all three within one bit. The first case is looked up by a whole segment
and a codeword of another, the second by three codewords: 33 bits of key or more.
"""

from __future__ import annotations

from itertools import combinations
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.llm import common, graph
from kudoscope.session import materialise

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = ((0, 21), (21, 21), (42, 22))
GENERATOR = 0b101011100011  # of the binary Golay code, degree 11


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; per syndrome the nearest error
    pattern, and the five patterns of weight 4 where the nearest has weight 3."""
    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    low = np.array([rest(v) for v in range(1 << 12)], dtype=np.int32)
    high = np.array([rest(v << 12) for v in range(1 << 11)], dtype=np.int32)
    unit = [rest(1 << b) for b in range(23)]
    nearest = np.full(2048, -1, dtype=np.int32)
    others: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = pattern = 0
            for b in bits:
                syndrome ^= unit[b]
                pattern |= 1 << b
            if weight < 4:
                nearest[syndrome] = pattern
            else:
                others[syndrome].append(pattern)
    width = max(map(len, others))
    table = np.array([(o + [-1] * width)[:width] for o in others], dtype=np.int32)
    return low, high, nearest, table


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest codeword, and of all within 4 bits (-1 where there are fewer)."""
    low, high, nearest, others = golay_tables()
    v = segment.astype(np.int32)
    syndrome = low[v & 0xFFF] ^ high[v >> 12]
    own = (v ^ nearest[syndrome]) >> 11
    far = others[syndrome]
    return own, np.column_stack([own, np.where(far < 0, -1, (v[:, None] ^ far) >> 11)])


def fuzzy_keys(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys under which a fingerprint is filed, and under which it looks for others.

    A pair within three bits shares a filed key of either with a looked-up key of the
    other. A key carries its case in the top bits.
    """
    u = prints.view(np.uint64)
    part = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own, near = zip(*(codewords(p) for p in part))
    own = [o.astype(np.int64) for o in own]
    near = [n.astype(np.int64) for n in near]
    filed, sought = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                case = np.int64(3 * i + j + 1) << 40
                filed.append((case | part[i] << 12 | own[j])[:, None])
                sought.append(np.where(near[j] < 0, -1, case | (part[i] << 12)[:, None] | near[j]))
    case = np.int64(15) << 40
    # the first segment is spread on the filed side, the others on the seeking side
    filed.append(np.where(near[0] < 0, -1, case | near[0] << 24 | (own[1] << 12 | own[2])[:, None]))
    both = (near[1] << 12)[:, :, None] | near[2][:, None, :]
    gap = (near[1] < 0)[:, :, None] | (near[2] < 0)[:, None, :]
    both = np.where(gap, -1, both | (case | own[0] << 24)[:, None, None]).reshape(len(u), -1)
    sought.append(both)
    return [np.hstack(filed), np.hstack(sought)]


def _key_table(prints: DataFrame) -> DataFrame:
    """``fp, filed, key`` rows; computed on blocks of fingerprints with numpy."""
    def keys(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            for at in range(0, len(fp), 4096):
                own = fp[at:at + 4096]
                for filed, table in zip((True, False), fuzzy_keys(own)):
                    row, column = np.nonzero(table >= 0)
                    yield pd.DataFrame({"fp": own[row], "filed": filed, "key": table[row, column]})

    return prints.select("fp").mapInPandas(keys, "fp long, filed boolean, key long")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of the fingerprints ``fp`` that differ in few bits, complete.

    A fingerprint's keys differ, so keys of distinct fingerprints need no shuffle of their
    own: the narrow fingerprints are dealt to the tasks, which write some seventy rows for each.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a number, as AQE goes by bytes before the keys
    table = materialise(_key_table(prints.select("fp").repartition(tasks, "fp").distinct()), "simhash-keys")
    filed = table.filter("filed").select("key", F.col("fp").alias("a"))
    sought = table.filter("not filed").select("key", F.col("fp").alias("b"))
    return (filed.join(sought, "key")
            .filter((F.col("a") < F.col("b"))
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b"))


def simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, copies, fp``: one row per distinct document row.

    A bit is set if it is set in more than half of the shingle hashes. Counting sums
    two bits in each long, 32 sums in all, next to the scan: only sums are shuffled.
    """
    w, n = F.col("words"), F.size("words")
    tokens = docs.select("doc_id", common.text_key(F.col("text")).alias("text_key"),
                         common.words(common.lower_ascii(F.col("text"))).alias("words"))
    spots = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    parts = [F.get(w, F.col("at") + k) for k in range(shingle)]
    spaced = F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:])
    text = F.when(n >= shingle, spaced).otherwise(F.array_join(w, " "))
    hashed = (tokens.select("doc_id", "text_key", "words", F.explode(spots).alias("at"))
              .select("doc_id", "text_key", "at", F.when(n > 0, F.xxhash64(text)).alias("h")))
    lane = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lane))).alias(f"s{j}") for j in range(32)]
    counted = hashed.groupBy("doc_id", "text_key").agg(
        F.count("h").alias("n"), F.count(F.when(F.col("at") == 0, 1)).alias("copies"), *sums)

    def bit(count: Column, place: int) -> Column:
        value = -(1 << 63) if place == 63 else 1 << place
        return F.when(2 * count > F.col("n"), F.lit(value)).otherwise(F.lit(0).cast("long"))

    fp = F.lit(0).cast("long")
    for j in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), j))
        fp = fp.bitwiseOR(bit(F.shiftrightunsigned(f"s{j}", 32), j + 32))
    return counted.select("doc_id", "text_key", "copies", F.coalesce(fp, F.lit(0)).alias("fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` per row of ``docs`` (doc_id, text).

    Documents link if their fingerprints differ in at most ``max_bits`` bits (3 at most,
    which is what the keys reach); a component takes the smallest doc_id in it. Equal
    fingerprints fall together before any pairing, so copies cost nothing. A null, empty
    or blank text has fingerprint 0 and links like any other; a text of fewer words than
    a shingle is one shingle. Rows that repeat give as many rows; a null doc_id counts
    only where a component has no other; extra columns are not read.
    """
    rows = materialise(simhash(docs, shingle), "simhash-prints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = graph.components(links(distinct, max_bits))
    rooted = (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.select("fp", "root").join(named, "root").drop("root"), "simhash-named")
    return (rows.join(named, "fp")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "text_key", "fp", "component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id; all its columns.

    Of rows that repeat one stays, and so does one of several texts under that id. Null,
    empty and blank texts are alike, so one of them stays. Rows that go are named by a
    narrow table, and texts move only to meet it, once: rows that repeat meet under the same
    column, a struct, in which nulls are equal. Columns may bear any names.
    """
    found = near_duplicates(docs, **options)
    chosen = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .groupBy("component_id", "doc_id").agg(F.min("text_key").alias("key")))
    # a key is never null, which a written table no longer says: the two structs are then of one type
    chosen = materialise(chosen.select("doc_id", "key"), "simhash-kept").select(
        F.struct("doc_id", F.coalesce("key", F.lit(0)).alias("text_key")).alias("at"))
    rows = docs.select(F.struct("*").alias("row"),
                       F.struct("doc_id", common.text_key(F.col("text")).alias("text_key")).alias("at"))
    return rows.join(chosen, "at", "left_semi").dropDuplicates(["at"]).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
