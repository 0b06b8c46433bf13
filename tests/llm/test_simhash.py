"""SimHash: exact fingerprints, complete links, components by brute force."""

import random

import numpy as np
import xxhash

from kudoscope.llm import graph, simhash
from llm_cases import docs, none, odd, rows, split_words  # noqa: F401


def fingerprint(text):
    w = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_of(prints):
    """Fingerprint -> component by brute force over all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def check(frame):
    want = [(r.doc_id, fingerprint(r.text)) for r in frame.select("doc_id", "text").collect()]
    groups = component_of({p for _, p in want})
    low = {}
    for d, p in want:
        if d is not None:
            low[groups[p]] = min(d, low.get(groups[p], d))
    got = [(r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=repr) == sorted([(d, p, low.get(groups[p])) for d, p in want], key=repr)


def test_given_table(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert simhash.near_duplicates(none).collect() == []


def test_links_are_complete(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        prints.add(base)
        for k in range(1, 5):
            near = base
            for b in rng.sample(range(64), k):
                near ^= 1 << b
            prints.add(near)
    prints |= {0, 1 << 63, (1 << 64) - 1, 7, 1 << 63 | 3}
    signed = [p - 2 ** 64 if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(frame).select("a", "b").collect()]
    assert set(got) == want


def test_golay_words_share_a_key_within_one_bit():
    v = np.arange(1 << 22)
    own, near = simhash.codewords(v)
    assert (near[:, 0] == own).all()
    assert set(np.unique((near >= 0).sum(axis=1))) == {1, 6}
    for b in range(22):
        assert (near == simhash.codewords(v ^ (1 << b))[0][:, None]).any(axis=1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert graph.components(frame.filter("a = 7 and b = 7")).collect() == []


def test_one_of_a_group_stays(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # null, empty and blank texts are one group; so are the long copies and the repeated rows
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 4, 6, 7, 8]
    assert rows(kept.filter("doc_id is null").select("doc_id")) == [(None,)]


def shuffles(frame, plan):
    """Shuffles in the plan of ``frame`` as it ran."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].count(plan)


def test_texts_are_shuffled_once(spark, odd):
    """Texts move to meet the ids that stay, and no second time to find rows that repeat."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(odd)
        assert shuffles(kept, "Exchange hashpartitioning") == 2     # the texts and the ids that stay
        assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 4, 6, 7, 8]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_are_not_shuffled_to_be_told_apart(spark, monkeypatch):
    """Keys of one fingerprint differ; a fingerprint named twice makes its keys once."""
    written = {}
    monkeypatch.setattr(simhash, "materialise", lambda frame, name: written.setdefault(name, frame))
    simhash.links(spark.createDataFrame([(7,), (7,), (-1,), (1 << 62,)], "fp long"))
    keys = written["simhash-keys"]
    found = keys.collect()
    assert len(found) == len(set(found)) and {r.fp for r in found} == {7, -1, 1 << 62}
    assert "key#" not in "".join(line for line in keys._jdf.queryExecution().executedPlan().toString().splitlines()
                                 if "Exchange" in line)
