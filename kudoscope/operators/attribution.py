"""Token attribution: which words pull a review towards positive or negative."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kudoscope.functions import text as tx
from kudoscope.functions.labels import DEFAULT_MODEL, EXTERNAL_MODEL
from kudoscope.operators.vectorise import wide_partitions

# Band limit of a single token, limit and length of the word lists.
BAND = 0.8
LISTED = 0.5
LIST_LENGTH = 5


def surrogate(model: str) -> str:
    """The linear model that explains ``model``."""
    return DEFAULT_MODEL if model in (EXTERNAL_MODEL, "transformer") else model


def term_differences(coefs: DataFrame) -> DataFrame:
    """``(term, diff)``: positive minus negative coefficient."""
    def of(c: str):
        return F.max(F.when(F.col("class") == c, F.col("coef")))
    return coefs.groupBy("term").agg((of("positive") - of("negative")).alias("diff"))


def explain_tokens(df: DataFrame, coefs: DataFrame, doc: str, text_col: str = "text") -> DataFrame:
    """Every token with position, difference (null when unknown) and band.

    A model has at most VOCABULARY_SIZE terms, which bounds what is broadcast.

    Texts are hashed by document before they fan out, so grouping the tokens of a
    review again (``top_words``) needs no shuffle; into as many partitions as their tokens need.
    """
    tokens = (df.select(doc, text_col).repartition(wide_partitions(df), doc)
              .select(doc, F.posexplode(tx.attribution_tokens(F.col(text_col)))
                      .alias("position", "token"))
              .withColumn("term", F.lower("token")))
    scored = tokens.join(F.broadcast(term_differences(coefs)), "term", "left")
    return scored.select(
        doc, "position", "token", "diff",
        F.when(F.col("diff") > BAND, "positive").when(F.col("diff") < -BAND, "negative")
         .otherwise("none").alias("band"))


def top_words(tokens: DataFrame, doc: str) -> DataFrame:
    """Per review: five strongest positive words, and of the negative words the five
    lowest listed least negative first, with absolute scores.

    A word has one ``diff``, so the weak ones go before anything is grouped."""
    unique = (tokens.filter(F.abs("diff") > LISTED)
              .groupBy(doc, F.lower("token").alias("word"))
              .agg(F.min("position").alias("first_use"), F.max("diff").alias("diff"))
              .withColumn("kind", F.when(F.col("diff") > 0, "positive").otherwise("negative")))
    strength = Window.partitionBy(doc, "kind").orderBy(
        F.abs("diff").desc(),
        F.when(F.col("kind") == "positive", F.col("first_use"))
         .otherwise(-F.col("first_use")).asc())
    listed = (unique.withColumn("_n", F.row_number().over(strength))
              .filter(F.col("_n") <= LIST_LENGTH))
    order = Window.partitionBy(doc, "kind").orderBy(F.col("diff").desc(), F.col("first_use").asc())
    return listed.select(doc, "kind", F.row_number().over(order).alias("rank"), "word",
                         F.abs("diff").alias("score"))
