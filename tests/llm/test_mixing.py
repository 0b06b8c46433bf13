"""Mixing: exact targets, quotas met, nothing beyond three passes, equal reruns."""

from collections import Counter

import pytest

from kudoscope.llm import common, mixing
from llm_cases import WORD, docs, none, odd, rows  # noqa: F401


def targets(sizes):
    """Share by weight, stop at three times the size, deal the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] < level * weight[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        open_ -= set(full)
    return out


def check(spark, frame, block_words=64):
    found = mixing.mix(frame, block_words=block_words)
    got = found.documents.collect()
    want = frame.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in want:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    expected = targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in want)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.5
    return found


def test_given_table_and_reruns(spark, docs):
    first = check(spark, docs)
    again = mixing.mix(docs.repartition(5), block_words=64)
    assert rows(first.documents) == rows(again.documents)


def test_odd_rows(spark, odd):
    check(spark, odd, block_words=7)


def test_small_sources_stop_at_three_passes(spark):
    text = "a b c d"
    frame = spark.createDataFrame([(i, text, "big" if i > 1 else f"s{i}") for i in range(60)],
                                  "doc_id long, text string, source string")
    check(spark, frame, block_words=3)


def test_empty(spark, none):
    assert mixing.mix(none).documents.collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(blank).documents.collect()} == {(1, 0, 0), (2, 0, 0)}


def test_blocks_are_equal_and_slots_keep_the_shares(spark, docs):
    found = mixing.mix(docs, block_words=64)
    per_slot = {r.slot: r.n for r in found.pieces.groupBy("slot").agg(
        {"to_word": "sum", "from_word": "sum"}).selectExpr(
        "slot", "`sum(to_word)` - `sum(from_word)` n").collect()}
    assert sum(n != 64 for n in per_slot.values()) <= found.sources.count()  # last blocks only
    plan = {r.slot: r.source_index for r in found.pieces.select("slot", "source_index").distinct().collect()}
    share = {r.source_index: r.quota for r in found.sources.collect()}
    total, order = sum(share.values()), sorted(plan)
    for cut in (len(order) // 4, len(order) // 2):
        seen = Counter(plan[s] for s in order[:cut])
        for s, quota in share.items():
            assert abs(seen[s] - cut * quota / total) <= 6  # low discrepancy


def test_prefix_sums(spark):
    frame = spark.range(500).selectExpr("id % 3 g", "id", "id >> 4 fine", "id >> 6 coarse", "id % 7 v")
    got = common.prefix_sums(frame, ["g"], "coarse", "fine", ["id"], "v", "before").collect()
    for r in got:
        assert r.before == sum(i % 7 for i in range(r.id) if i % 3 == r.g)
