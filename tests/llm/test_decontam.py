"""Decontamination against a brute-force comparison of every alignment."""

import itertools
import random
import re

import pytest
from llm_cases import docs, none, odd  # noqa: F401

from kudoscope.llm import common, decontam

SMALL = "/root/testdata/sf0.001"


def plain(text):
    return [w for w in re.split(r"[\x09-\x0D\x20]+", "".join(
        c for c in (text or "").lower() if c.isalnum() or c.isspace())) if w]


def brute(docs, items):
    """Pairs whose best alignment overlaps enough, over all alignments."""
    out = set()
    for d, text in docs:
        w = plain(text)
        for i, t in items:
            q = plain(t)
            if len(q) < decontam.MIN_WORDS:
                continue
            for shift in range(-len(q) + 1, len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == q[k] for k in range(len(q))]
                best = max((sum(same[k:k + 20]) for k in range(len(q) - 19)), default=0) if len(q) > 20 else 0
                if sum(same) >= 0.8 * len(q) or best >= 16:
                    out.add((d, i))
                    break
    return out


def found(docs, items):
    return {(r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()}


def test_given_table(spark, docs):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    sample = docs.filter("length(text) < 1500")  # brute force is quadratic
    want = brute([(r.doc_id, r.text) for r in sample.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(sample, items) == want and want


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(40)]
    rows, held = [], set()
    for d in range(60):
        w = [f"n{rng.randrange(400)}" for _ in range(rng.randrange(120))]
        piece = list(item)
        for k in rng.sample(range(40), d % 7):  # up to 6 of 40 words changed
            piece[k] = "zz"
        if d % 2:
            w[rng.randrange(len(w) + 1):0] = piece
            held.add((d, 1))
        rows.append((d, " ".join(x.upper() + "!" if d % 3 == 0 else x for x in w)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([(1, " ".join(item)), (2, "s1 s2 s3 s4 s5 s6"), (3, "too short"), (4, None)],
                                  "item_id long, text string"), held)


def test_substitutions_are_tolerated(planted):
    docs, items, held = planted
    assert found(docs, items) == held


def test_both_joins_agree(planted, monkeypatch):
    docs, items, held = planted
    monkeypatch.setattr(common, "small_enough", lambda df, rows=0: False)
    assert found(docs, items) == held


def test_short_items_and_parts_of_long_ones(spark, planted):
    _, items, _ = planted
    rows = [(1, "a s1 s2 s3 s4 s5 s6 b"), (2, "s1 s2 s3 s4 s5 x s6"), (3, "too short"),
            (4, " ".join(f"q{i}" for i in range(10, 34))), (5, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), items) == {(1, 2), (4, 1)}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert found(odd, items) == {(6, 1)}
    nothing = items.filter("item_id < 0")
    assert found(odd, nothing) == set() and found(none, items) == set()
    kept = decontam.clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_no_python_on_the_main_path(spark, planted):
    docs, items, _ = planted
    plan = decontam.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_allowed_substitutions_spoil_all_seeds():
    for n in range(decontam.TOLERANT, 26):
        windows = [{p + o - m[0] for o in m} for m in decontam.masks_of(n) for p in range(n - (m[-1] - m[0]))]
        assert all(any(not w & set(gone) for w in windows) for gone in itertools.combinations(range(n), n // 5)), n


def test_changed_words_of_short_items(spark):
    rng, items, held = random.Random(6), [], []
    for n in range(10, 26):
        items.append((n, " ".join(f"i{n}w{k}" for k in range(n))))
        for _ in range(20):
            piece = [f"i{n}w{k}" for k in range(n)]
            for k in rng.sample(range(n), n // 5):
                piece[k] = "zz"
            held.append((len(held), f"a b {' '.join(piece)} c"))
    items, frame = (spark.createDataFrame(items, "item_id long, text string"),
                    spark.createDataFrame(held, "doc_id long, text string"))
    want = brute(held, [tuple(r) for r in items.collect()])
    assert len(want) == len(held) and found(frame, items) == want


def spoiled(windows, gone, left):
    """True if ``left`` more words can be changed so that every window holds a changed one."""
    whole = next((w for w in windows if not w & gone), None)
    return whole is None or left > 0 and any(spoiled(windows, gone | {o}, left - 1) for o in whole)


def test_seeds_have_gaps_and_are_proven():
    for n in range(decontam.TOLERANT, 40):
        masks = decontam.masks_of(n)
        assert all(m[-1] >= len(m) for m in masks)
        windows = [frozenset(p + o for o in m) for m in masks for p in range(n - m[-1])]
        assert not spoiled(windows, frozenset(), n // 5), n


def test_short_items_against_brute_force(spark):
    rng, items, texts = random.Random(8), [], []
    for n in [3, 4, *range(7, 10)]:
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        texts.append((len(texts), " ".join(["a", *words, "b"])))
        for changed in (1, 2) if n >= decontam.TOLERANT else ():
            for _ in range(12):
                piece = list(words)
                for k in rng.sample(range(n), changed):
                    piece[k] = "zz"
                texts.append((len(texts), " ".join(["a", "b", *piece][rng.randrange(3):])))
    got = found(spark.createDataFrame(texts, "doc_id long, text string"),
                spark.createDataFrame(items, "item_id long, text string"))
    want = brute(texts, items)
    assert got == want and {i for _, i in want} == {3, 4, 7, 8, 9}


def test_long_items_against_brute_force(spark):
    """As many words changed as allowed, crowded into the middle or spread, in items of 26 to 79 words."""
    rng, items, texts = random.Random(9), [], []
    for n in (26, 30, 35, 39, 44, 50, 79):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for turn in range(12):
            changed, piece = n // 5 + turn % 2, list(words)
            start = rng.randrange(n - changed)
            for k in range(start, start + changed) if turn % 3 else rng.sample(range(n), changed):
                piece[k] = "zz"
            texts.append((len(texts), " ".join(piece)))
    got = found(spark.createDataFrame(texts, "doc_id long, text string"),
                spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(texts, items) and len(got) >= 70


def test_items_that_share_an_id_or_have_none(spark):
    items = spark.createDataFrame([(1, "one two three four"), (1, "five six seven eight"), (None, "nine ten eleven"),
                                   (2, "nine ten eleven")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "five six seven eight"), (None, "x nine ten eleven"), (3, "one two three")],
                                  "doc_id long, text string")
    assert found(texts, items) == {(1, 1), (None, None), (None, 2)}


def test_no_overlap_below_the_proven_one(planted):
    docs, items, _ = planted
    with pytest.raises(ValueError):
        decontam.contamination(docs, items, min_overlap=0.7)
