"""Weighted sampling: edits, neighbours, and likeness against generalised Jaccard."""

import hashlib
import random
from collections import Counter

import numpy as np
from llm_cases import docs, none, odd, split_words  # noqa: F401

from kudoscope.llm import weighted


def jaccard(a, b):
    x, y = Counter(split_words(a)), Counter(split_words(b))
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def check(frame, draws=16):
    pairs = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    ids = [d for d, _ in pairs]
    got = weighted.edit_check(frame, draws=draws).collect()
    assert sorted(map(repr, ids)) == sorted(repr(r.doc_id) for r in got)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if len(set(ids)) == len(ids) and None not in ids:
        ordered = sorted(pairs, reverse=True)
        sampler = weighted.Sampler(draws)
        found = {r.doc_id: r for r in got}
        for (d, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
            half = len(text) // 2
            new = text[:len(text) - half] + after[:half]
            assert found[d].n_chars == len(text)
            assert found[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            own, other = sampler.signature(text), sampler.signature(new)
            assert found[d].fingerprint == weighted.as_hex(own)
            assert found[d].edited_fingerprint == weighted.as_hex(other)
            assert found[d].near_edited == weighted.likeness(own, other)
            assert found[d].near_next == weighted.likeness(own, sampler.signature(after))
    return got


def test_given_table(docs):
    check(docs)


def test_odd_rows(spark, odd, none):
    got = check(odd)
    blank = [r for r in got if r.doc_id in (1, 2)]
    assert {r.fingerprint for r in blank} == {""} and {r.n_chars for r in blank} == {0}
    assert {r.fingerprint for r in got if r.doc_id == 4} == {r.fingerprint for r in got if r.doc_id == 5}
    assert check(none) == []
    assert check(odd.filter("doc_id = 7"))[0].near_next == 1.0


def test_many_ranges_meet(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            check(docs.select("doc_id", "text", "lang"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_likeness_estimates_generalised_jaccard():
    rng = random.Random(3)
    sampler = weighted.Sampler(draws=2048)
    for _ in range(8):
        a = " ".join(rng.choice("abcdefghijkl") * 3 for _ in range(rng.randrange(5, 80)))
        b = a + " " + " ".join(rng.choice("ghijklmnop") * 3 for _ in range(rng.randrange(5, 80)))
        near = weighted.likeness(sampler.signature(a), sampler.signature(b))
        assert abs(near - jaccard(a, b)) < 0.05


def test_variates_have_their_distributions():
    r, log_c, beta, _ = weighted.Sampler(draws=64).variates([b"w%d" % i for i in range(2000)])
    assert abs(r.mean() - 2) < 0.02 and abs(r.var() - 2) < 0.05
    assert abs(np.exp(log_c).mean() - 2) < 0.02 and abs(beta.mean() - 0.5) < 0.01
    assert abs(np.corrcoef(r.ravel(), log_c.ravel())[0, 1]) < 0.02


def test_a_small_cache_changes_nothing(docs, monkeypatch):
    texts = [r.text for r in docs.limit(30).collect()]
    whole = [weighted.as_hex(weighted.Sampler().signature(t)) for t in texts]
    monkeypatch.setattr(weighted, "_TERMS", 50)
    monkeypatch.setattr(weighted, "_BLOCK", 16)
    sampler = weighted.Sampler()
    assert [weighted.as_hex(sampler.signature(t)) for t in texts] == whole
