"""Hard negatives against a plain loop over all pairs."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kudoscope.llm import negatives
from kudoscope.llm.queries import ORACLE
from llm_cases import SMALL, rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, every=50, positives=5, count=3):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    held = []
    for i, v, label in vectors:
        if i is not None and label is not None and fine(v):
            row = (i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label, tuple(v))
            if row not in held:
                held.append(row)
    out = []
    for a in held:
        if a[0] % every:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(a[1], r[1])), -2 ** 63), 2 ** 63 - 1), r[0], r[2])
                        for r in held if r is not a and len(r[1]) == len(a[1]))
        for s, p, _ in [r for r in scored if r[2] == a[2]][:positives]:
            fits = [r for r in scored if r[2] != a[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:count]
            out += [(a[0], p, k, r[1], -s, -r[0]) for k, r in enumerate(fits, 1)]
    return sorted(out, key=repr)


def answer(spark, vectors, every=50):
    frame = spark.createDataFrame(vectors, SCHEMA)
    return rows(negatives.hard_negatives(frame, F.col("vec_id") % every == 0))


def some(seed, n, dim, labels, scale=1.0, coarse=None):
    rng = random.Random(seed)
    def number():
        x = rng.gauss(0, scale)
        return round(x * coarse) / coarse if coarse else x
    return [(i, [number() for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_given_table(spark):
    given = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SMALL}/embeddings.parquet' ORDER BY 1").fetchall()
    given = [(i, list(v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in given]
    got = rows(negatives.op13_hard_negatives(spark, SMALL))
    assert got == brute(given) and got
    for name in ("embeddings",):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    told = duckdb.sql("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score "
                      f"FROM ({ORACLE['op13_hard_negatives']})").fetchall()
    assert sorted(told, key=repr) == got


def test_ties_across_blocks(spark, monkeypatch):
    """Coarse components give many equal scores, zeros among them; blocks of a few rows."""
    monkeypatch.setattr(negatives, "ROW_BLOCK", 7)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    vectors = some(1, 120, 3, 3, coarse=2) + [(200, [0.0, 0.0, 0.0], 0)]
    got = answer(spark, vectors, 10)
    assert got == brute(vectors, 10) and any(r[4] == r[5] == 0 for r in got)


def test_odd_rows(spark):
    vectors = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.25], 2), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2),
               (3, [0.8, 0.5], None), (4, None, 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 2),
               (7, [float("inf"), 1.0], 2), (None, [0.9, 0.5], 2), (8, [0.7, 0.4], 2), (9, [0.9, 0.1, 0.2], 2),
               (50, [1.0, 1.0, 1.0], 3), (10, [0.9, 0.9, 0.9], 3), (11, [0.5, 0.9, 0.9], 4), (100, [], 5), (12, [], 5),
               (13, [], 6), (150, [3e38, 3e38, 0.0, 1.0], 7), (14, [3e38, 2e38, 0.0, 1.0], 7), (15, [3e37] * 4, 8),
               (200, [-1.0, 1.0, 0.0, 1.0], 7), (-50, [1.0, 0.5], 2)]
    got = answer(spark, vectors)
    assert got == brute(vectors) and got
    wide = spark.createDataFrame([(*r, 1, 2, b"3") for r in vectors], SCHEMA + ", mark int, dim int, key binary")
    assert rows(negatives.hard_negatives(wide, F.col("vec_id") % 50 == 0)) == got
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).collect() == []


def test_a_third_alike(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 16)
    vectors = some(2, 100, 4, 4)
    vectors += [(1000 + i, vectors[0][1], 1) for i in range(50)] + [vectors[3]] * 40
    assert answer(spark, vectors, 20) == brute(vectors, 20)


def test_keys_sort_as_numbers():
    rng = random.Random(4)
    picks = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 5, -7]
    values = [(rng.choice(picks), rng.choice(picks), rng.choice(picks), rng.choice([0, 1]), rng.choice(picks),
               rng.choice(picks)) for _ in range(400)]
    packed = [negatives.pack(*[np.array([x]) for x in v[:3]], v[3], *[np.array([x]) for x in v[4:]])
              for v in values]
    assert [negatives.unpack(k) for k in packed] == values
    assert [negatives.unpack(k) for k in sorted(packed)] == sorted(values, key=lambda v: (v[0], v[1], -v[2], *v[3:]))


def test_windows_do_not_overflow():
    for s in (0, 1, -1, 7, 99, 101, 2 ** 63 - 1, -2 ** 63 + 1):
        low, high = negatives.window_of(s)
        assert 50 * s <= 100 * low < 50 * s + 100 and 95 * s - 100 < 100 * high <= 95 * s
