"""Margin machines with squared hinge loss, one per class, fitted side by side.

Spark's own machine has the plain hinge, which has no gradient at its corners. Here the
losses and gradients of all classes are one sum over the rows, taken in the partitions and
added up in a tree; the driver holds vectors as long as the vocabulary and a bounded
sample of rows, which only says in what directions the loss is steep. The sample changes
the number of passes over the rows, never what the passes converge to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import DataFrame

from kudoscope.schemas import LABELS

TOLERANCE = 1e-6    # of the largest component of the gradient of the mean loss
_BLOCK = 1024       # rows held as one block
_SAMPLE = 2500      # rows that shape the steps, about
_SLAB = 1000        # terms of the sample that are dense at a time
_REST = 0.1         # share of the curvature along a term that the sample is taken to miss

# Labels, entries per row, and term and value of every entry; the last term of a row is always 1.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(rows: Iterator) -> Iterator[Block]:
    def block(some: list) -> Block:
        vectors = [r["features"] if isinstance(r["features"], SparseVector) else
                   Vectors.sparse(len(r["features"]), dict(enumerate(r["features"]))) for r in some]
        sizes = np.array([len(v.indices) + 1 for v in vectors])
        terms = np.concatenate([np.append(v.indices, v.size) for v in vectors])
        values = np.concatenate([np.append(v.values, 1.0) for v in vectors])
        label = np.array([LABELS.index(r["sentiment"]) for r in some], dtype="int8")
        return label, sizes, terms.astype(np.min_scalar_type(int(terms.max()))), values

    held = []
    for r in rows:
        held.append(r)
        if len(held) == _BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _side(label: np.ndarray, k: int) -> np.ndarray:
    return np.where(label == k, 1.0, -1.0)


def _along(line: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Product of every row with ``line``."""
    return np.add.reduceat(values * line.take(terms), np.cumsum(sizes) - sizes)


def _back(pull: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Sum of the rows, each times its ``pull``."""
    return np.bincount(terms, values * np.repeat(pull, sizes), minlength=width)


def _sums(blocks: Iterator[Block], w: np.ndarray, p: np.ndarray | None) -> Iterator[np.ndarray]:
    """Sums over some blocks as one flat array: per class the squared hinges, then their
    gradient, or their second derivative at ``w`` along ``p``."""
    losses, out = np.zeros(len(w)), np.zeros(w.shape)
    for label, sizes, terms, values in blocks:
        rows = sizes, terms.astype(np.intp), values
        for k in range(len(w)):
            if p is not None and not p[k].any():
                continue
            side = _side(label, k)
            short = np.maximum(0.0, 1 - side * _along(w[k], *rows))
            losses[k] += short @ short
            pull = -2 * side * short if p is None else 2 * (short > 0) * _along(p[k], *rows)
            out[k] += _back(pull, *rows, w.shape[1])
    yield np.append(losses, out)


def _squares(blocks: Iterator[Block], width: int) -> Iterator[np.ndarray]:
    """Sum of the squared values of every term over some blocks."""
    out = np.zeros(width)
    for _, _, terms, values in blocks:
        out += np.bincount(terms.astype(np.intp), values * values, minlength=width)
    yield out


def _drawn(at: int, blocks: Iterator[Block], share: float) -> Iterator[Block]:
    """About ``share`` of the rows, the same ones whenever the blocks are the same."""
    draw = np.random.default_rng(at)
    for label, sizes, terms, values in blocks:
        take = draw.random(len(label)) < share
        if take.any():
            entries = np.repeat(take, sizes)
            yield label[take], sizes[take], terms[entries], values[entries]


def _shaper(sample: list[Block], n: int, squares: np.ndarray) -> Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """For coefficients, the inverse of the curvature there as the sample shows it.

    The curvature is a diagonal plus that of the sample's rows that fall short, scaled up
    to all rows; its inverse needs a matrix of sample times sample only. The diagonal comes
    from the ``squares`` of the terms over all rows, as most samples miss most rare terms.
    """
    label, sizes, terms, values = (np.concatenate(part) for part in zip(*sample))
    rows, m, width = (sizes, terms.astype(np.intp), values), len(label), len(squares)
    scale = 2 * n / m
    diagonal = 1 + 2 * _REST * squares
    row, common = np.repeat(np.arange(m), sizes), np.zeros((m, m))
    for start in range(0, width, _SLAB):
        here = (rows[1] >= start) & (rows[1] < start + _SLAB)
        slab = np.zeros((m, _SLAB))
        slab[row[here], rows[1][here] - start] = values[here] / np.sqrt(diagonal[rows[1][here]])
        common += slab @ slab.T

    def at(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        held = []
        for k, line in enumerate(w):
            short = _side(label, k) * _along(line, *rows) < 1
            inner = common * short * short[:, None]
            inner[np.diag_indices(m)] += 1 / scale
            held.append((short, np.linalg.inv(inner)))

        def solve(r: np.ndarray) -> np.ndarray:
            out = r / diagonal
            for k, (short, inverse) in enumerate(held):
                out[k] -= _back(short * (inverse @ (short * _along(out[k], *rows))), *rows, width) / diagonal
            return out

        return solve

    return at


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
             curve: Callable[[np.ndarray, np.ndarray], np.ndarray],
             shape: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]],
             start: np.ndarray, tolerance: float, max_passes: int) -> np.ndarray:
    """Newton steps by conjugate gradients, every line of ``start`` on its own problem, in step.

    ``evaluate`` gives losses and gradients, ``curve`` the second derivatives along
    directions, ``shape`` an approximate inverse of them. Ends when no component of a
    gradient exceeds ``tolerance``, or after ``max_passes`` calls of the first two.
    """
    w, (f, g) = start, evaluate(start)
    passes = 1
    while passes < max_passes and (steep := np.abs(g).max(axis=1, initial=0.0)).max(initial=0.0) > tolerance:
        solve, x, r = shape(w), np.zeros_like(w), -g
        # steps need not be exact far from the end; finished lines stay
        enough = np.maximum(0.3 * tolerance, np.minimum(0.1, np.sqrt(steep / max(1.0, steep.max()))) * steep)
        live = steep > tolerance
        z = solve(r)
        p, rz = z * live[:, None], (r * z).sum(axis=1)
        while live.any() and passes < max_passes:
            bent = curve(w, p)
            passes += 1
            length = np.where(live, rz / np.maximum((p * bent).sum(axis=1), 1e-300), 0.0)[:, None]
            x, r = x + length * p, r - length * bent
            live = live & (np.abs(r).max(axis=1) > enough)
            z = solve(r)
            rz, before = (r * z).sum(axis=1), rz
            p = np.where(live[:, None], z + (rz / np.maximum(before, 1e-300))[:, None] * p, 0.0)
        size, slope = np.ones(len(w)), (g * x).sum(axis=1)
        while True:
            f_new, g_new = evaluate(w + size[:, None] * x)
            passes += 1
            # near the end the fall is smaller than the rounding of the sums
            worse = f_new > f + 1e-4 * size * slope + 1e-12 * np.abs(f)
            if not worse.any() or size.min() < 1e-10 or passes >= max_passes:
                break
            size = np.where(worse, size / 2, size)
        w, f, g = w + size[:, None] * x, f_new, g_new
    return w


def fit(train: DataFrame, max_passes: int, tolerance: float = TOLERANCE) -> list[LinearSVCModel]:
    """One machine per class of LABELS on rows with ``features`` and ``sentiment``.

    Minimises sum(max(0, 1 - y m)^2) + |w|^2 / 2, that of C = 1, in which the intercept is a
    coefficient like the others. Rows with another label than LABELS fail.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    # every pass starts a task per partition, so many small ones are read together
    blocks = (train.select("features", "sentiment").rdd.coalesce(4 * context.defaultParallelism)
              .mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK))
    n = blocks.map(lambda b: len(b[0])).sum()
    first = train.select("features").first()
    width = (first["features"].size if first else 0) + 1
    w = np.zeros((len(LABELS), width))

    def summed(at: np.ndarray, p: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast((at, p))
        total = blocks.mapPartitions(lambda b: _sums(b, *shared.value)).treeReduce(np.add)
        shared.destroy()
        return total[:len(at)], total[len(at):].reshape(at.shape)

    def evaluate(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        losses, gradient = summed(at)
        return (losses + (at * at).sum(axis=1) / 2) / n, (gradient + at) / n

    def curve(at: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (summed(at, p)[1] + p) / n

    if n:
        share = _SAMPLE / n
        sample = blocks.mapPartitionsWithIndex(lambda i, b: _drawn(i, b, share)).collect()
        squares = blocks.mapPartitions(lambda b: _squares(b, width)).treeReduce(np.add)
        shaper = _shaper(sample, n, squares) if sample else lambda at: lambda r: r
        w = minimise(evaluate, curve, shaper, w, tolerance, max_passes)
    blocks.unpersist()
    java = context._jvm.org.apache.spark.ml.classification.LinearSVCModel
    machines = []
    for c, line in zip(LABELS, w):
        vector = _py2java(context, Vectors.dense(line[:-1]))
        machine = LinearSVCModel(java(f"squared_hinge_{c}", vector, float(line[-1])))
        machine.setFeaturesCol("features").setPredictionCol(f"claims_{c}").setRawPredictionCol(f"margin_{c}")
        machines.append(machine)
    return machines
