"""Substring deduplication against a brute-force pass over all windows."""

import hashlib
import random

import duckdb
import pytest

from kudoscope.llm import queries, substring
from llm_cases import docs, none, odd, rows, split_words  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def brute(pairs, window=50):
    low = {}
    for d, t in pairs:
        w = split_words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if d is not None:
                low[k] = min(d, low.get(k, d))
    out = []
    for d, t in pairs:
        w = split_words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and low[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return sorted(out, key=repr)


def check(frame):
    pairs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = [(r.doc_id, len(r.words), len(r.words) - len(r.kept), r.kept)
           for r in substring.strip_repeats(frame).select("doc_id", "words", "kept").collect()]
    assert sorted(got, key=repr) == brute(pairs)


def test_cover_holds_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(31))


def test_given_table(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert substring.strip_repeats(none).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_at_any_place(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    made = []
    for d in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(80))]
        a = rng.randrange(0, 70)
        w[rng.randrange(len(w) + 1):0] = passage[a:a + rng.choice([20, 49, 50, 51, 90])]
        made.append((d if d % 13 else d + 1, "\n".join(w)))
    check(spark.createDataFrame(made, "doc_id long, text string"))


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.ORACLE["op4_substring_dedup"]).fetchall()
    got = rows(substring.op4_substring_dedup(spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == sorted(want, key=repr)
    assert hashlib.sha256(b"").hexdigest() != got[0][3]
