"""Fixtures and plain-Python twins shared by the tests of this folder."""

import re

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{i % 977}x" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3),
            (4, long_text, "en", "b", len(long_text)), (5, long_text, "en", "b", len(long_text)),
            (6, "one two three four five six seven", "en", "a", 33),
            (6, "one two three four five six seven", "en", "a", 33),
            (7, "single", "fr", "", 6), (None, "a row without an id and some words", "de", "c", 30),
            (8, "Zoë’s naïve 𝒳 text — ünïcode stays", "fr", "c", 30)]
    clash = "size int, words string, _id int, _key string, _spans string, _w int, starts int, id int, key int, row int"
    frame = spark.createDataFrame([r + (i, "x", i, "k", "s", 1, 2, 3, 4, 5) for i, r in enumerate(rows)],
                                  f"{DOCS}, {clash}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split_words(text):
    return WORD.findall(text or "")


def rows(df):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
