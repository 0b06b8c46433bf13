"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds three of them, the
first rotated by two places, the second by one, by multiplying them; a text is the
sum of its trigrams, a language the sum of its texts, and the closest language by
cosine wins.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from kudoscope.llm import common

DIMENSIONS = 512
SEED = 7
FOLDS = 5              # documents of fold 0 are held out
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_CACHE = 40_000        # trigram vectors a task keeps
_BASE = 0x110000


class Profiles(NamedTuple):
    languages: tuple[str, ...]
    vectors: np.ndarray  # one unit row per language


class Encoder:
    """Trigram counts and vectors of texts; vectors of trigrams are kept while there is room."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.empty((0, self.dimensions), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.default_rng([self.seed, code])
            self.letters[code] = rng.integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return self.letters[code]

    @staticmethod
    def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and counts; words are lower-cased, edged with spaces, letters only."""
        words = _LETTERS.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = " " + " ".join(words) + " "
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        grams = (codes[:-2] * _BASE + codes[1:-1]) * _BASE + codes[2:]
        return np.unique(grams, return_counts=True)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigram vectors, each as often as it occurs."""
        out = np.zeros(self.dimensions, dtype=np.float64)
        for at in range(0, len(grams), _CACHE // 2):
            part, n = grams[at:at + _CACHE // 2], counts[at:at + _CACHE // 2]
            fresh = [g for g in part.tolist() if g not in self.place]
            if len(self.place) + len(fresh) > _CACHE:
                self._clear()
                fresh = part.tolist()
            if fresh:
                made = np.empty((len(fresh), self.dimensions), dtype=np.float32)
                for i, g in enumerate(fresh):
                    a, b, c = g // (_BASE * _BASE), g // _BASE % _BASE, g % _BASE
                    made[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
                    self.place[g] = len(self.place)
                need = len(self.place)
                if need > len(self.rows):
                    grown = np.empty((min(max(2 * need, 4096), _CACHE), self.dimensions), dtype=np.float32)
                    grown[:need - len(fresh)] = self.rows[:need - len(fresh)]
                    self.rows = grown
                self.rows[need - len(fresh):need] = made
            where = np.fromiter(map(self.place.__getitem__, part.tolist()), np.int64, len(part))
            out += n.astype(np.float32) @ self.rows[where]
        return out


def profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Learn a prototype from all rows of ``docs`` with text and non-null lang.

    Tasks add up vectors per language; Spark adds those; the driver gets one vector
    per language.
    """
    def add(batches):
        encoder, total = Encoder(dimensions, seed), {}
        for batch in batches:
            merged: dict[str, list] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                merged.setdefault(lang, []).append(encoder.trigrams(text))
            for lang, parts in merged.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([n for _, n in parts]), len(grams))
                total[lang] = total.get(lang, 0) + encoder.bundle(grams, counts)
        for lang, vector in total.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": vector})

    known = docs.filter("lang is not null and text is not null").select("lang", "text")
    sums = (known.mapInPandas(add, "lang string, place int, value double")
            .groupBy("lang", "place").agg(F.sum(F.round("value").cast("long")).alias("value")).toPandas())
    found = {}
    for lang, part in sums.groupby("lang"):
        vector = part.sort_values("place")["value"].to_numpy(dtype=np.float64)
        if np.linalg.norm(vector) > 0:
            found[lang] = vector / np.linalg.norm(vector)
    names = tuple(sorted(found))
    return Profiles(names, np.array([found[n] for n in names]).reshape(len(names), dimensions))


def identify(docs: DataFrame, learned: Profiles, seed: int = SEED) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the rows of ``docs``; only the text is looked at.

    ``score`` is the cosine with the winner, cut to 0 to 1. A text that is null or has no
    letters is ``und`` with score 0, and so is every text if nothing was learned; equal
    cosines go to the name that sorts first. Columns of ``docs`` stay, except those two.
    """
    names, vectors = learned

    @F.pandas_udf("lang_pred string, score double")
    def closest(texts: pd.Series) -> pd.DataFrame:
        encoder, out = Encoder(vectors.shape[1], seed), []
        for text in texts:
            grams, counts = encoder.trigrams(text)
            if not len(grams) or not names:
                out.append((UNKNOWN, 0.0))
                continue
            vector = encoder.bundle(grams, counts)
            cosine = vectors @ vector / max(np.linalg.norm(vector), 1e-12)
            best = int(cosine.argmax())
            out.append((names[best], float(min(max(cosine[best], 0.0), 1.0))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return (docs.withColumn("_closest", closest("text"))
            .withColumns({c: F.col(f"_closest.{c}") for c in ("lang_pred", "score")}).drop("_closest"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other four folds of five.

    A null doc_id counts as held out: no remainder says that it may be learned from.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    learned = profiles(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), learned).drop("text")
