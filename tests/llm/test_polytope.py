"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from kudoscope.llm import polytope
from llm_cases import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs of rows in double precision."""
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        return x / np.linalg.norm(x)

    n = len(vectors)
    x = [unit(v) for _, v, _ in vectors]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            a, b = vectors[i], vectors[j]
            if (x[i] is not None and x[j] is not None and a[2] is not None and a[2] == b[2]
                    and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, v in enumerate(vectors):
        if v[0] is not None:
            low[find(i)] = min(v[0], low.get(find(i), v[0]))
    return sorted([(v[0], links[i], low.get(find(i)), v[0] == low.get(find(i))) for i, v in enumerate(vectors)],
                  key=repr)


def answer(spark, vectors):
    frame = spark.createDataFrame(vectors, SCHEMA)
    return rows(polytope.near_duplicates(frame))


def around(rng, base, spread, n):
    noise = rng.normal(size=(n, len(base)))
    return base + spread * noise / np.linalg.norm(noise, axis=1)[:, None]


def clusters(seed, sizes, dim=64, labels=3):
    rng = np.random.default_rng(seed)
    out = []
    for k, (size, spread) in enumerate(sizes):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        out += [(v.astype(np.float32).tolist(), k % labels) for v in around(rng, base, spread, size)]
    order = rng.permutation(len(out))
    return [(int(i), *out[k]) for i, k in enumerate(order)]


def test_clusters_of_any_tightness(spark):
    vectors = clusters(1, [(30, 0.02), (25, 0.1), (40, 0.14), (30, 0.2), (20, 0.3), (1, 0.1), (1, 0.1)] * 2)
    assert answer(spark, vectors) == brute(vectors)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = polytope.units(rng.normal(size=(5000, 64)))
    z = rng.normal(size=x.shape)
    z = polytope.units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * z
    a, b = polytope.bucket_codes(x), polytope.bucket_codes(y)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.999


@pytest.mark.parametrize("spread", [0.05, 0.12, 0.17])
def test_crowded_buckets(spark, monkeypatch, spread):
    """Balls and blocks, forced by small limits, change nothing."""
    monkeypatch.setattr(polytope, "CROWD", 8)
    monkeypatch.setattr(polytope, "BLOCK", 16)
    vectors = clusters(5, [(150, spread), (60, 0.1), (60, 0.16), (5, 0.1)], labels=1)
    vectors += [(1000 + i, vectors[0][1], 0) for i in range(80)]     # copies: a fifth of all rows
    assert answer(spark, vectors) == brute(vectors)


def test_odd_rows(spark):
    v = [0.5, 0.25, 0.125]
    vectors = [(1, v, 1), (2, [x * 2 for x in v], 1), (3, v, 2), (4, None, 1), (5, v, None), (6, [0.0, 0.0, 0.0], 1),
               (7, [0.5, None, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (9, [float("nan"), 1.0, 1.0], 1),
               (10, [], 1), (11, v[:2], 1), (12, [2.0], 1), (13, [3.0], 1), (1, v, 1), (14, [1e38, 1e38], 3),
               (15, [1e-38, 1e-38], 3), (None, [1.0, 0.0, 0.0], 9), (None, [1.0, 0.0, 0.0], 9), (None, v, 2),
               (16, [-0.5, -0.25, -0.125], 1)]
    assert answer(spark, vectors) == brute(vectors)
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in vectors],
                                  SCHEMA + ", cid int, n int, code int, h1 int")
    assert rows(polytope.near_duplicates(frame)) == brute(vectors)
    assert polytope.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_transform_keeps_angles():
    x = np.random.default_rng(0).normal(size=(50, 32))
    y = polytope.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T)
    assert np.allclose(polytope.hadamard(y), x)
