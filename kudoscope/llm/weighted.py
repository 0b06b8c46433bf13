"""Document fingerprints by consistent weighted sampling.

Every word has, for each of K draws, two gamma variates and a uniform one, all made
from a hash of the word. A draw keeps the word with the smallest sampled value and
the quantised weight at which it was sampled; two texts agree on a draw with the
probability of their generalised Jaccard similarity, sum of minima over sum of
maxima of their word counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from kudoscope.llm import common
from kudoscope.session import materialise

DRAWS = 64
SEED = 11
_TERMS = 60_000  # words whose variates a task keeps
_BLOCK = 4096    # terms of a text evaluated at once


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of texts; the variates of words are kept while there is room.

    With r, c ~ gamma(2, 1) and beta uniform, a word of weight S is sampled at level
    t = floor(ln S / r + beta) with ln a = ln c - r (t - beta) - r. At weight 1 the level
    is 0, so ln c + r beta - r is kept for each word and most words need no more.
    """

    def __init__(self, draws: int = DRAWS, seed: int = SEED):
        self.draws, self.seed = draws, seed
        steps = np.arange(1, 2 * draws + 1, dtype=np.uint64).reshape(2, draws)
        self.steps = steps * np.uint64(0x9E3779B97F4A7C15)
        self.place: dict[bytes, int] = {}
        room = (_TERMS, draws)
        self.base, self.r, self.beta = (np.empty(room, dtype=np.float32) for _ in range(3))
        self.hashes = np.empty(_TERMS, dtype=np.uint64)

    def variates(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c, beta and the hash of each word; two 64-bit hashes a draw give five numbers."""
        h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in words], dtype=np.uint64)
        bits = _mixed(h[:, None, None] + self.steps)
        unit, half, low = np.float32(2 ** -24), np.float32(0.5), np.uint64(0xFFFFFF)
        first = ((bits >> np.uint64(40)).astype(np.float32) + half) * unit
        second = (((bits >> np.uint64(16)) & low).astype(np.float32) + half) * unit
        log_product = np.log(first * second)
        rest = (bits[:, 0] & np.uint64(0xFFFF)) << np.uint64(8) | (bits[:, 1] & np.uint64(0xFF))
        beta = (rest.astype(np.float32) + half) * unit
        return -log_product[:, 0], np.log(-log_product[:, 1]), beta, h

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Where the variates of the words stand; makes those that are not there."""
        found = list(map(self.place.get, words))
        missing = [w for w, i in zip(words, found) if i is None]
        if missing:
            if len(self.place) + len(missing) > len(self.hashes):
                self.place, missing = {}, words
            at = len(self.place)
            rows = slice(at, at + len(missing))
            r, log_c, beta, self.hashes[rows] = self.variates(missing)
            self.base[rows], self.r[rows], self.beta[rows] = log_c + r * (beta - 1), r, beta
            self.place.update(zip(missing, range(at, at + len(missing))))
            found = list(map(self.place.get, words))
        return np.array(found, dtype=np.int64)

    def signature(self, text: str | None) -> np.ndarray:
        """K samples of 16 bits; empty for a text without words."""
        # bytes are split at tab to carriage return and space, which is the word rule
        counts = Counter(text.encode("utf-8", "surrogatepass").split()) if text else {}
        if not counts:
            return np.empty(0, np.uint16)
        words = list(counts) if len(counts) <= _BLOCK else sorted(counts)
        best = np.full(self.draws, np.inf, np.float32)
        sample = np.zeros(self.draws, np.uint64)
        column = np.arange(self.draws)
        for at in range(0, len(words), _BLOCK):
            part = words[at:at + _BLOCK]
            rows = self._rows(part)
            order = self.hashes[rows].argsort()  # ties between samples fall the same way every time
            rows, n = rows[order], np.array([counts[w] for w in part], dtype=np.float32)[order]
            log_a = self.base[rows]
            many = np.flatnonzero(n > 1)
            level = np.zeros((len(many) + 1, self.draws), np.float32)  # the last row is for words of weight 1
            if len(many):
                r = self.r[rows[many]]
                level[:-1] = np.floor(np.log(n[many])[:, None] / r + self.beta[rows[many]])
                log_a[many] -= r * level[:-1]
            low = log_a.argmin(axis=0)
            where = np.full(len(rows), len(many))
            where[many] = np.arange(len(many))
            steps = level[where[low], column].astype(np.int64).astype(np.uint64)
            code = self.hashes[rows[low]] + steps * np.uint64(0x9E3779B97F4A7C15)
            value = log_a[low, column]
            better = value < best
            best = np.where(better, value, best)
            sample = np.where(better, code, sample)
        return (_mixed(sample) >> np.uint64(48)).astype(np.uint16)


def as_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; 1 for two texts without words, 0 if only one has none."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def fingerprint(docs: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Add ``fingerprint`` (4 hex digits a draw) to rows of ``docs``; nothing is shuffled.

    A null, empty or blank text has the empty fingerprint. Equal texts have equal
    fingerprints. Columns of ``docs`` stay, except one of that name.
    """
    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        sampler = Sampler(draws, seed)
        return pd.Series([as_hex(sampler.signature(t)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", sign("text"))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(sampler: Sampler, text: str, following: str, known: OrderedDict) -> tuple:
    def signature(t: str) -> np.ndarray:
        if t not in known:
            known[t] = sampler.signature(t)
            while len(known) > 4:
                known.popitem(last=False)
        return known[t]

    changed = edited(text, following)
    own, other, after = signature(text), sampler.signature(changed), signature(following)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own),
            as_hex(other), likeness(own, other), likeness(own, after))


def edit_check(docs: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edit takes its new half from the next document by descending doc_id; the last
    one takes it from the first. Documents without a doc_id come last, and rows with
    equal doc_id follow each other by a hash of their text, so repeated rows are
    neighbours. A null text counts as empty; a table of one row follows itself; an
    empty table gives an empty result; only doc_id and text are read.

    Texts are dealt once, by ranges of doc_id, and read in order. Only the last row of
    a range misses its follower: it is finished from the first row of the next range,
    one text per range.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", key)] + StructType.fromDDL(
        f"{_RESULT}, part int, first boolean, last boolean, text string").fields)

    result = StructType([StructField("doc_id", key)] + StructType.fromDDL(_RESULT).fields)

    def walk(batches):
        sampler, known = Sampler(draws, seed), OrderedDict()
        part, before, first = TaskContext.get().partitionId(), None, True
        out = []
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                if first:
                    out.append((doc, *[None] * 6, part, True, False, text))
                    first = False
                else:
                    out.append((before[0], *_compare(sampler, before[1], text, known), part, False, False, None))
                before = (doc, text)
                if len(out) >= 2000:
                    yield frame(out)
                    out = []
        if before:
            out.append((before[0], *[None] * 6, part, False, True, before[1]))
        if out:
            yield frame(out)

    def frame(out):
        table = pd.DataFrame(out, columns=schema.names)
        return table.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})

    order = [F.col("doc_id").desc_nulls_last(), common.text_key(F.col("text"))]
    ranged = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").desc_nulls_last())
              .sortWithinPartitions(*order))
    rows = materialise(ranged.mapInPandas(walk, schema), "weighted-rows")
    ends = rows.filter("first or last")
    # ranges that have rows, each with the next of them; the last is followed by the first
    parts = ends.filter("first").select("part")
    following = parts.withColumn("next", F.coalesce(
        F.lead("part").over(Window.orderBy("part")), F.lit(parts.agg(F.min("part")).first()[0])))
    heads = ends.filter("first").select(F.col("part").alias("next"), F.col("text").alias("follower"))
    open_rows = (ends.filter("last").select("doc_id", "text", "part").join(following, "part")
                 .join(heads, "next").select("doc_id", "text", "follower"))

    def finish(batches):
        sampler = Sampler(draws, seed)
        for batch in batches:
            out = [(d, *_compare(sampler, t, f, OrderedDict()))
                   for d, t, f in zip(batch["doc_id"], batch["text"], batch["follower"])]
            yield pd.DataFrame(out, columns=result.names).astype({"doc_id": "Int64"})

    return rows.filter("not first and not last").select(*result.names).unionByName(
        open_rows.mapInPandas(finish, result))


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return edit_check(common.table(spark, sf_dir, "documents"))
