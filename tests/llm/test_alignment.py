"""Alignment against whole texts encoded at once and byte offsets taken from token bytes alone."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from kudoscope.llm import alignment
from llm_cases import docs, none, odd, rows  # noqa: F401

TEXTS = ["plain words here", " leading space", "trailing ", "two  spaces", "tabs\tand\nlines\r\n x", "a▁b word", "é",
         "naïve café — “quoted” …", "日本語 text 中", "😀 smile 🧿\U0010FFFD", "<|endoftext|> and <s> </s> <unk> <0x41>", "",
         None, "\x00 nul", " nbsp  x", "it's we'll 'tis don't  'x", "a" * 500, "x y" * 40, "ﬁ ½ ² Å Å",
         " line sep  \u0085next", "word▁ x", " ", "   ", "\n\n", "1234567 89 0.5e-3", "—　全角 ＡＢ", "\x1cfs \x1d x"]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers.of()


def plain(tokenizers, text):
    """Groups and links of one text by its own encoding, or none."""
    al = tokenizers.aligner()
    if not text:
        return [], []
    raw = (" " + text).encode()
    ids_a = al.a.encode(" " + text, add_special_tokens=False).ids
    ids_b = al.b.encode(text, return_type=int)
    if b"".join(al.bytes_a[i] for i in ids_a) != raw or b"".join(al.bytes_b[i] for i in ids_b) != raw:
        return [], []
    end_a = {int(e): k + 1 for k, e in enumerate(np.cumsum([len(al.bytes_a[i]) for i in ids_a]))}
    end_b = {int(e): k + 1 for k, e in enumerate(np.cumsum([len(al.bytes_b[i]) for i in ids_b]))}
    groups, i, k = [], 0, 0
    ends = sorted(set(end_a) & set(end_b))
    for e in ends:
        groups.append((ids_a[i:end_a[e]], ids_b[k:end_b[e]]))
        i, k = end_a[e], end_b[e]
    return groups, ends


def brute(tokenizers, pairs):
    """Rows of the query for (doc_id, text) pairs."""
    found = [(d, plain(tokenizers, t)[0]) for d, t in pairs]
    count = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for d, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def answer(frame, tokenizers, tmp, spark, monkeypatch):
    monkeypatch.setattr(alignment.common, "table", lambda *_: frame)
    got = alignment.op12_token_alignment(spark, tmp)
    return rows(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_given_table(spark, docs, tokenizers, monkeypatch):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert answer(docs, tokenizers, "", spark, monkeypatch) == brute(tokenizers, pairs)


def test_hard_texts(spark, tokenizers, monkeypatch):
    pairs = list(enumerate(TEXTS + [a + " " + b for a in TEXTS[:20] if a for b in TEXTS[5:12] if b]))
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    assert answer(frame, tokenizers, "", spark, monkeypatch) == brute(tokenizers, pairs)
    for d, _, _, groups, links, ends in alignment.align(frame, tokenizers, with_ends=True).collect():
        want, cuts = plain(tokenizers, pairs[d][1])
        assert ends == cuts and len(links) == len(want)
        assert groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)


def test_odd_rows(spark, odd, none, tokenizers, monkeypatch):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    wide = odd.withColumnRenamed("size", "links").withColumnRenamed("words", "n_a")
    assert answer(wide, tokenizers, "", spark, monkeypatch) == brute(tokenizers, pairs)
    assert answer(none, tokenizers, "", spark, monkeypatch) == []


def test_forgetting_changes_nothing(tokenizers, monkeypatch):
    fresh = alignment.Aligner(tokenizers.byte_bpe, tokenizers.pieces)
    texts = [t for t in TEXTS * 3]
    want = [c.to_pylist() for c in fresh.documents(texts)]
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "TOGETHER", 2)
    again = [[], [], [], []]
    for t in texts:
        for held, c in zip(again, fresh.documents([t])):
            held += c.to_pylist()
    assert again == want


def test_remembered_segments_are_small(tokenizers):
    """Two workers of an executor remember hundreds of thousands of segments each."""
    fresh = alignment.Aligner(tokenizers.byte_bpe, tokenizers.pieces)
    text = " ".join(f"{i * 7919 % 100003}-word{i}" for i in range(10_000))
    tracemalloc.start()
    fresh.documents([text])
    held = tracemalloc.get_traced_memory()[0] + fresh.packed_groups().nbytes
    tracemalloc.stop()
    assert len(fresh.number) == 10_000 and held < 500 * 10_000


def test_whole_texts_where_words_are_not_apart(tokenizers):
    """A tokenizer that may join across spaces gets whole texts, with the same result here."""
    fresh = alignment.Aligner(tokenizers.byte_bpe, tokenizers.pieces)
    apart = [c.to_pylist() for c in fresh.documents(TEXTS)]
    assert fresh.by_word
    fresh.by_word = False
    fresh.forget()
    assert [c.to_pylist() for c in fresh.documents(TEXTS)] == apart


def test_linked_tokens_are_suffixes(tokenizers):
    al = tokenizers.aligner()
    assert len(al.pairs) <= 2 * sum(len(x) for x in al.bytes_a + al.bytes_b)
    for key in al.pairs[::997]:
        a, b = al.bytes_a[key // len(al.bytes_b)], al.bytes_b[key % len(al.bytes_b)]
        assert a.endswith(b) or b.endswith(a)
