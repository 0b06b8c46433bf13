"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight per feature serves all grades; ordered thresholds turn the same score into
P(grade >= k). The expected severity is the sum of those probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kudoscope.llm import common

SAMPLE_ROWS = 20_000   # about so many labelled rows are fitted on, drawn by a hash of doc_id
FEATURES = 3_000       # features kept, by how far their rows lie above the base rate
MIN_ROWS = 8           # labelled rows that must hold a feature
LEVELS = 3             # a token counts once, twice, three times or more
PREFIXES = (4, 5, 6, 7)
RIDGE = 0.25
STEPS = 400
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000


class OrdinalModel(NamedTuple):
    """``P(grade >= k) = sigmoid(score - thresholds[k - 1])``."""
    weights: dict[str, tuple[float, ...]]  # token -> weight at each level
    thresholds: tuple[float, ...]


def tokens_of(word: str) -> list[str]:
    """A word and its beginnings; beginnings catch families of words that share one."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def counted(text: str | None) -> Counter:
    """How often each token occurs, up to LEVELS; none for null."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for token in tokens_of(word):
            found[token] += n
    return found


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 harmless, 1 toxic, 2 toxic in text of low quality.

    Rows without a doc_id or a toxic mark are no labels; of several labels of a
    document the most severe holds.
    """
    toxic = F.col("toxic") == 1
    grade = F.when(toxic & (F.col("quality") == 0), 2).when(toxic, 1).otherwise(0)
    return (labels.filter("doc_id is not null and toxic is not null")
            .groupBy("doc_id").agg(F.max(grade).alias("grade")))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``grade, text`` of about ``rows`` labelled documents, the same ones each time.

    The labels are thinned before the join, which bounds what is broadcast.
    """
    graded = grades(labels)
    share = min(1.0, rows / max(graded.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = graded.filter(draw < F.lit(int(share * 1_000_000)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, rows, harm``: labelled rows that hold a feature, and the sum of their grades."""
    def count(batches):
        total: Counter = Counter()
        harm: Counter = Counter()
        for batch in batches:
            for grade, text in zip(batch["grade"], batch["text"]):
                held = [f"{t}|{k}" for t, n in counted(text).items() for k in range(1, min(n, LEVELS) + 1)]
                total.update(held)
                if grade:
                    harm.update(dict.fromkeys(held, int(grade > 0)))
            if len(total) > _MEMO:
                yield pd.DataFrame([(f, n, harm[f]) for f, n in total.items()], columns=["feature", "rows", "harm"])
                total, harm = Counter(), Counter()
        yield pd.DataFrame([(f, n, harm[f]) for f, n in total.items()],
                           columns=["feature", "rows", "harm"]).astype({"rows": "int64", "harm": "int64"})

    found = sample.mapInPandas(count, "feature string, rows long, harm long")
    return found.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("harm").alias("harm"))


def fit_ordinal(x_row: np.ndarray, x_col: np.ndarray, y: np.ndarray, n_features: int, n_grades: int,
                ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise the ridge-penalised negative log
    likelihood of a cumulative-link model with binary features, by Adam over all rows."""
    n, cuts = len(y), n_grades - 1
    counts = np.array([max((y >= k).sum(), 0.5) for k in range(1, n_grades)]) / n
    start = np.log((1 - np.minimum(counts, 0.999)) / np.minimum(counts, 0.999))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    p = np.concatenate([np.zeros(n_features), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def cumulative(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, steps + 1):
        w, theta = p[:n_features], np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
        score = np.bincount(x_row, w[x_col], minlength=n)
        above = np.column_stack([np.ones(n), *[cumulative(score - t) for t in theta], np.zeros(n)])
        rows = np.arange(n)
        mass = np.maximum(above[rows, y] - above[rows, y + 1], 1e-9)
        slope = above * (1 - above)
        g_score = -(slope[rows, y] - slope[rows, y + 1]) / mass
        g_theta = np.zeros(cuts)
        for k in range(cuts):
            g_theta[k] = (slope[:, k + 1] / mass)[y == k + 1].sum() - (slope[:, k + 1] / mass)[y == k].sum()
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(x_col, g_score[x_row], minlength=n_features) + ridge * w,
                            tail[:1], tail[1:] * np.exp(p[n_features + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * (1 - step / (steps + 1))
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    theta = np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
    return p[:n_features], theta


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        n_features: int = FEATURES) -> OrdinalModel:
    """Fit on a bounded sample of labelled rows. The driver gets ``n_features`` counts and,
    of about ``sample_rows`` rows, the indices of those features; never a text.

    Without labels, or with one grade only, no text is toxic.
    """
    sample = labelled_sample(docs, labels, sample_rows)
    base = sample.agg(F.count(F.lit(1)), F.sum((F.col("grade") > 0).cast("long"))).first()
    if not base[1] or base[1] == base[0]:
        return OrdinalModel({}, (30.0, 31.0))
    rate = base[1] / base[0]
    excess = (F.col("harm") - F.col("rows") * rate) / F.sqrt(F.col("rows") * rate * (1 - rate))
    chosen = (_feature_counts(sample).filter(F.col("rows") >= MIN_ROWS)
              .orderBy(excess.desc(), "feature").limit(n_features).select("feature").toPandas()["feature"])
    index = {f: i for i, f in enumerate(sorted(chosen))}

    def design(batches):
        for batch in batches:
            held = [[index[f] for t, n in counted(text).items() for k in range(1, min(n, LEVELS) + 1)
                     if (f := f"{t}|{k}") in index] for text in batch["text"]]
            yield pd.DataFrame({"grade": batch["grade"].astype("int32"), "held": [sorted(h) for h in held]})

    # sorted, so that the fit doesn't depend on the order in which tasks end
    matrix = sorted((r.grade, tuple(r.held)) for r in
                    sample.mapInPandas(design, "grade int, held array<int>").collect())
    y = np.array([g for g, _ in matrix])
    rows = np.repeat(np.arange(len(matrix)), [len(h) for _, h in matrix])
    cols = np.array([c for _, h in matrix for c in h], dtype=np.int64)
    w, theta = fit_ordinal(rows, cols, y, len(index), 3)
    weights: dict[str, list[float]] = {}
    for f, i in index.items():
        token, _, level = f.rpartition("|")
        weights.setdefault(token, [0.0] * LEVELS)[int(level) - 1] = float(w[i])
    return OrdinalModel({t: tuple(np.cumsum(v)) for t, v in weights.items()}, tuple(map(float, theta)))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Add ``severity`` (0 to 2), ``p_toxic`` (0 to 1), ``grade`` and ``toxic`` to rows of ``docs``.

    A null or empty text holds no feature and gets the base rate of the model. Every
    row is scored whole and on its own: nothing is shuffled. Columns of ``docs`` stay,
    except those that bear the four names, which are replaced.
    """
    weights, thresholds = model.weights, np.array(model.thresholds)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def grade(texts: pd.Series) -> pd.DataFrame:
        memo: dict[str, list[str]] = {}
        sums = np.empty(len(texts))
        for i, text in enumerate(texts):
            held: Counter = Counter()
            for word in _WORD.findall(text.lower()) if text else ():
                known = memo.get(word)
                if known is None:
                    if len(memo) > _MEMO:
                        memo.clear()
                    known = memo[word] = [t for t in tokens_of(word) if t in weights]
                for token in known:
                    held[token] += 1
            sums[i] = sum(weights[t][min(n, LEVELS) - 1] for t, n in sorted(held.items()))
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - sums[:, None], -30, 30)))
        mass = np.column_stack([1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]])
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0],
                             "grade": mass.argmax(axis=1).astype("int32"), "toxic": above[:, 0] >= 0.5})

    scored = docs.withColumn("_grade", grade("text"))
    names = ("severity", "p_toxic", "grade", "toxic")
    return scored.withColumns({n: F.col(f"_grade.{n}") for n in names}).drop("_grade")


def harmless(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not toxic; all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return score(rows, fit(docs, labels, **options)).filter("not toxic").select("_row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity and grade."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")
