"""TF-IDF over single words and word pairs, as a table and as ML pipeline stages."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer,
                                SQLTransformer)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from kudoscope.functions import text as tx
from kudoscope.functions.columns import compute_once
from kudoscope.session import discard, materialise

# Fixed value: size of the vocabulary.
VOCABULARY_SIZE = 10_000
# About how many times the bytes of a text its terms take.
FAN_OUT = 8
# Rows, about, that say which terms are counted one by one; so many times the vocabulary; and
# the groups in which all other terms are counted.
SAMPLE_ROWS = 5_000
CANDIDATES = 3
GROUPS = 1 << 20


# The terms of `text.ngrams(text.words(...))` as a statement, which a saved pipeline
# can hold; built-in functions spare the tokeniser and n-gram stages their UDFs.
_TERMS_SQL = """
SELECT *, concat(words, if(size(words) < 2, array(), zip_with(
         slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1),
         (a, b) -> concat(a, ' ', b)))) AS terms
FROM (SELECT *, filter(split({clean}, ' '), w -> length(w) >= 2) AS words FROM __THIS__)"""


def wide_partitions(df: DataFrame) -> int:
    """Partitions for texts that fan out into terms inside them."""
    return FAN_OUT * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def occurrences(df: DataFrame, clean: str = "clean_text", *keep: str) -> DataFrame:
    """``(*keep, term)`` for every occurrence of a single word or pair.

    Each word is laid beside the next one and joined to it as a row, not inside an array, where
    a function is interpreted for every element.
    """
    words = df.select(*keep, tx.words(F.col(clean)).alias("_words"))
    beside = words.select(*keep, F.inline(F.arrays_zip(
        "_words", F.slice("_words", F.lit(2), F.size("_words")))).alias("_word", "_next"))
    return (beside.select(*keep, F.explode(F.array("_word", F.concat("_word", F.lit(" "), "_next"))).alias("term"))
            .filter(F.col("term").isNotNull()))


def document_terms(df: DataFrame, doc: str, clean: str = "clean_text") -> DataFrame:
    """``(doc, term)`` for every occurrence of a single word or pair.

    The texts are hashed by document once, before they fan out into terms: every
    later grouping by document finds that partitioning and does not shuffle. Their
    bytes grow by that, so there are ``FAN_OUT`` times the usual partitions, which a number
    of partitions also keeps from being put together again by the size of the texts.
    """
    return occurrences(df.select(doc, clean).repartition(wide_partitions(df), doc), clean, doc)


def term_totals(df: DataFrame, clean: str = "clean_text") -> DataFrame:
    """``(term, total, df)``: occurrences of every single word or pair, and rows that have it.

    Repeats are told apart inside each row, so nothing is held per row and term: a task
    holds the distinct terms of its rows only, and the texts are not shuffled.
    """
    held = compute_once(df.select(clean), _terms=tx.ngrams(tx.words(F.col(clean)))).select("_terms")
    seen = F.concat(F.transform("_terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("first"))),
                    F.transform(F.array_distinct("_terms"),
                                lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("first"))))
    return (held.select(F.inline(seen)).groupBy("term")
            .agg(F.sum("n").alias("total"), F.sum("first").alias("df")))


def vocabulary(totals: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent terms with corpus count and document count."""
    return totals.orderBy(F.col("total").desc(), F.col("term").asc()).limit(size)


def frequent_terms(df: DataFrame, clean: str = "clean_text", size: int = VOCABULARY_SIZE,
                   sample_rows: int = SAMPLE_ROWS, groups: int = GROUPS) -> list[str]:
    """The terms of ``vocabulary(term_totals(df))``, in its order, in memory that does not grow with ``df``.

    The most frequent terms of a sample are counted one by one over all rows, all others summed
    up in ``groups`` by their hash. A term in a group that stays below the ``size``-th count
    cannot be among the first; the terms of the other groups are counted one by one as well. So
    the sample changes what is held and how many passes there are, never the terms.
    """
    spark, n = df.sparkSession, df.count()
    texts = df.select(clean)

    def first(terms: DataFrame, k: int) -> list:
        return vocabulary(terms.groupBy("term").agg(F.count(F.lit(1)).alias("total")), k).collect()

    if n <= sample_rows:
        return [r["term"] for r in first(occurrences(texts, clean), size)]
    drawn = texts.filter(F.pmod(F.xxhash64(clean), F.lit(n)) < sample_rows)
    picked = [r["term"] for r in first(occurrences(drawn, clean), CANDIDATES * size)]
    known = F.broadcast(spark.createDataFrame(list(enumerate(picked)), "key long, term string"))
    group = len(picked) + F.pmod(F.xxhash64("term"), F.lit(groups))
    counted = materialise(
        occurrences(texts, clean).join(known, "term", "left").select(F.coalesce("key", group).alias("key"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("total")), "term-groups")
    found = [(-r["total"], picked[r["key"]]) for r in counted.filter(F.col("key") < len(picked)).collect()]
    least = -sorted(found)[size - 1][0] if len(found) >= size else 1
    full = counted.filter((F.col("key") >= len(picked)) & (F.col("total") >= least)).select("key")
    if not full.isEmpty():
        rest = occurrences(texts, clean).join(known.select("term"), "term", "left_anti")
        # at most a key per group, so it may be broadcast: terms of other groups are not shuffled
        rest = rest.withColumn("key", group).join(F.broadcast(full), "key", "left_semi")
        found += [(-r["total"], r["term"]) for r in first(rest, size)]
    discard(counted)
    return [term for _, term in sorted(found)[:size]]


def tfidf_table(df: DataFrame, doc: str, clean: str = "clean_text",
                size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(doc, term, tf, tfidf)`` with smoothed idf and unit length per document; ``doc`` is unique."""
    held = materialise(df.select(doc, clean), "texts")
    documents = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((documents + 1) / (F.col("df") + 1)) + 1
    # the vocabulary is limited to `size` rows, so it may be broadcast; joined before
    # counting it drops most pairs, which occur too rarely to be in it
    terms = df.sparkSession.createDataFrame([(t,) for t in frequent_terms(held, clean, size)], "term string")
    once = held.select(F.explode(F.array_distinct(tx.ngrams(tx.words(F.col(clean))))).alias("term"))
    known = F.broadcast(once.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weighted = (document_terms(held, doc, clean).join(known, "term").groupBy(doc, "term")
                .agg(F.count(F.lit(1)).alias("tf"), F.max("df").alias("df"))
                .withColumn("weight", F.col("tf") * idf))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", "tf", (F.col("weight") / length).alias("tfidf"))


def ngram_counts(df: DataFrame, clean: str = "clean_text") -> DataFrame:
    """Corpus count of every term; counted per partition before the shuffle."""
    return occurrences(df, clean).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def fit_transform(train: DataFrame, doc: str, *keep: str, clean: str = "clean_text",
                  size: int = VOCABULARY_SIZE) -> tuple[PipelineModel, DataFrame]:
    """Pipeline from ``clean_text`` to ``features``, fitted on the training rows only, and
    their ``(*keep, features)``. Every row is a document; ``doc``, which names it, is unique.

    Only the vocabulary (at most ``size`` rows) comes to the driver. Building the
    stages from it keeps the cut at ``size`` deterministic. The counts of every row are
    written once: the documents that have a term are counted from them, and ``features``
    is arithmetic on them.
    """
    terms = frequent_terms(train, clean, size)
    counting = [SQLTransformer(statement=_TERMS_SQL.format(clean=clean)),
                CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf")]
    tf = materialise(PipelineModel(counting).transform(train.select(doc, *keep, clean)).select(*keep, "tf"), "counts")
    held = tf.agg(Summarizer.metrics("count", "numNonZeros").summary(F.col("tf")).alias("s")).select("s.*").first()
    n, dfs = held["count"], held["numNonZeros"].toArray()
    idf = [math.log((1 + n) / (1 + int(d))) + 1 for d in dfs]
    weighing = [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="weighted"),
                Normalizer(p=2.0, inputCol="weighted", outputCol="features")]
    vectoriser = PipelineModel([*counting, *weighing, SQLTransformer(
        statement="SELECT * EXCEPT (words, terms, tf, weighted) FROM __THIS__")])
    return vectoriser, PipelineModel(weighing).transform(tf).select(*keep, "features")


def vocabulary_of(vectoriser: PipelineModel) -> list[str]:
    return next(s for s in vectoriser.stages if isinstance(s, CountVectorizerModel)).vocabulary
