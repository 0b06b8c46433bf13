"""Languages: held-out accuracy, and what a prediction may look at."""

import numpy as np
from llm_cases import docs, none, odd  # noqa: F401

from kudoscope.llm import langid


def test_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.op6_langid(spark, "/root/testdata/sf0.01").collect()}
    want = [r for r in frame.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(want) > 100 and len(got) == frame.count()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in want) >= 0.97 * len(want)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_text_is_looked_at(docs):
    learned = langid.profiles(docs)
    other = docs.selectExpr("doc_id + 7 doc_id", "text", "'xx' lang", "'s' source")
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, learned).collect()}
    b = {r.doc_id - 7: (r.lang_pred, r.score) for r in langid.identify(other, learned).collect()}
    assert a == b


def test_odd_rows(spark, odd, none, docs):
    learned = langid.profiles(docs)
    got = {r.doc_id: r for r in langid.identify(odd, learned).collect()}
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (1, 2, 3))
    assert got[6].lang_pred in learned.languages and len(langid.identify(odd, learned).collect()) == odd.count()
    assert langid.identify(none, learned).collect() == []
    nothing = langid.profiles(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 --"), (2, "..."), (3, "½ ² Ⅳ")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.identify(digits, learned).collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    encoder = langid.Encoder(64)
    grams, counts = encoder.trigrams("Ab ab")
    want = sum(np.roll(encoder.letter(ord(a)), 2) * np.roll(encoder.letter(ord(b)), 1) * encoder.letter(ord(c))
               for a, b, c in (" ab", "ab ", "b a", " ab", "ab "))
    assert (encoder.bundle(grams, counts) == want).all()
    monkeypatch.setattr(langid, "_CACHE", 4)
    small = langid.Encoder(64)
    long = "the quick brown fox jumps over the lazy dog"
    assert np.allclose(small.bundle(*small.trigrams(long)), encoder.bundle(*encoder.trigrams(long)))
