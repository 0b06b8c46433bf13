"""Scalar text functions against hand-written values."""

import random

import duckdb
import pandas as pd
import pytest
from conftest import one
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from kudoscope.functions import text as tx
from kudoscope.plans import oracle

def t():
    return F.col("t")



@pytest.mark.parametrize("raw,cleaned", [
    ("<p>This is a test.</p>", "is test"),
    ("I don't like this product.", "do not like product"),
    ("this is a very good item", "is good item"),
    ("", ""),
    (None, ""),
    ("Check http://example.com for details", "check details"),
    ("I can't", "cannot"),
    ("It won't, it WASN'T", "will not was not"),
    ("good good not good", "good good not good"),
    ("don’t stop", "stop"),                              # curly apostrophe: don + t
    ("see http://a.b great", "see great"),          # no-break space ends a URL
    ("café au lait", "caf au lait"),
    ("I <3 it", ""),
    ("awwwesome day", "day"),
    ("x < y and y > z", "x z"),
])
def test_clean_text(spark, raw, cleaned):
    assert one(spark, tx.clean_text(t().cast("string")), t=raw) == cleaned


def test_clean_text_random_against_sql(spark):
    rng = random.Random(7)
    parts = ["<b>", "</b>", "<", ">", "http://x.y", "www.", "don't", "isn't", "the", "not", " ",
             "\x1c", "\u00a0", "é", "Zürich", "a1b", "\u2003", "\n", "\t", "'", "good", "rn't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    got = dict(spark.createDataFrame(list(enumerate(texts)), "i int, t string")
               .select("i", tx.clean_text(t())).collect())
    frame = pd.DataFrame({"i": range(len(texts)), "t": texts})  # noqa: F841  (read by DuckDB)
    want = dict(duckdb.sql(f"SELECT i, {oracle.clean('t')} FROM frame").fetchall())
    assert got == want


def test_unclosed_tags_and_inner_spaces_stay_linear(spark):
    text = "<a> " + "<" * 60_000 + " " * 60_000 + "end "
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(F.length(tx.strip_html(t())), F.length(tx.trim_spaces(t()))).first()
    assert row[0] == len(text) - 2 and row[1] == len(text) - 1


def test_stopwords_agree_with_sparks_list():
    base = set(StopWordsRemover.loadDefaultStopWords("english"))
    fragments = {p for w in base for p in w.split("'") if "'" in w}
    plain = {w for w in base if "'" not in w} | fragments | {"ain", "ma", "mightn", "needn", "o", "y"}
    plain -= {"cannot", "ought", "let"}
    assert set(tx.REMOVED_WORDS) == plain - set(tx.KEPT_WORDS)
    assert len(tx.KEPT_WORDS) == 22 and len(tx.CONTRACTIONS) == 17


@pytest.mark.parametrize("raw,out", [
    ("  a b ", "a b"), (" a ", "a"), ("", ""), (" \n\t", ""), ("a", "a"), ("\x1ca\x1f", "a"),
])
def test_trim(spark, raw, out):
    assert one(spark, tx.trim_spaces(t()), t=raw) == out == raw.strip()


@pytest.mark.parametrize("raw,blank", [(None, True), ("", True), ("  \n", True), (" x ", False)])
def test_blank(spark, raw, blank):
    assert one(spark, tx.is_blank(t().cast("string")), t=raw) is blank


def test_combined_text(spark):
    assert one(spark, tx.combined_text(t(), F.col("h").cast("string")), t=" body ", h=None) == "body"
    assert one(spark, tx.combined_text(t(), F.col("h")), t="", h=" head ") == "head"
    assert one(spark, tx.combined_text(t(), F.col("h")), t=" ", h=" ") == ""


def test_ids(spark):
    import hashlib
    want = "rev_" + hashlib.sha256("u1_B01_0_text".encode()).hexdigest()[:16]
    got = one(spark, tx.review_id(F.col("u"), F.col("p"), F.col("s").cast("bigint"), t()),
              u="u1", p="B01", s=None, t="text")
    assert got == want
    a = one(spark, tx.place_review_id(F.col("p"), F.col("a"), t()), p="p", a="x", t="é")
    assert a == "g_" + hashlib.sha256("p_x_é".encode()).hexdigest()[:16]


@pytest.mark.parametrize("ms,out", [(None, ""), (0, ""), (1588687728923, "2020-05-05 14:08:48"),
                                    (-1000, "1969-12-31 23:59:59")])
def test_epoch(spark, ms, out):
    assert one(spark, tx.epoch_ms_to_utc(F.col("m").cast("bigint")), m=ms) == out


def test_snippets(spark):
    long = "x" * 281
    assert one(spark, tx.snippet(t()), t=long) == "x" * 280 + "…"
    assert one(spark, tx.snippet(t()), t="x" * 280) == "x" * 280
    assert one(spark, tx.snippet(t(), 70, "..."), t=long) == "x" * 70 + "..."
    assert one(spark, tx.snippet(t(), always=True), t="ab") == "ab…"


def test_html_escape(spark):
    import html
    raw = "<a href='x'>\"A&B\" &amp;</a>"
    assert one(spark, tx.html_escape(t()), t=raw) == html.escape(raw)


@pytest.mark.parametrize("raw", ["", " a  b c\n", "one", None])
def test_token_count(spark, raw):
    assert one(spark, tx.token_count(t().cast("string")), t=raw) == len((raw or "").split())


@pytest.mark.parametrize("raw,tokens", [
    ("Don't stop!  Now…\n", ["Don", "'", "t", " ", "stop", "!", "  ", "Now", "…", "\n"]),
    ("", []), (None, []),
    ("a_b c-d", ["a_b", " ", "c", "-", "d"]),
    ("Café №5", ["Café", " ", "№", "5"]),
    ("½ cup,\u00a0²", ["½", " ", "cup", ",", "\u00a0", "²"])])
def test_attribution_tokens(spark, raw, tokens):
    assert one(spark, tx.attribution_tokens(t().cast("string")), t=raw) == tokens


@pytest.mark.parametrize("clean,terms", [
    ("", []), ("good", ["good"]), ("a good x day", ["good", "day", "good day"]),
    ("aa bb cc", ["aa", "bb", "cc", "aa bb", "bb cc"])])
def test_ngrams(spark, clean, terms):
    assert one(spark, tx.ngrams(tx.words(t())), t=clean) == terms
