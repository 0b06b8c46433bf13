"""Preference formatting against plain Python."""

from llm_cases import rows

from kudoscope.llm import chat

SIDES = "pair_id long, side string, turn long, role string, text string"


def check(spark, pairs):
    """pairs: id -> (chosen, rejected) lists of (turn, role, text), in order of turn."""
    data = [(p, side, *t) for p, both in pairs.items() for side, turns in zip(("chosen", "rejected"), both) for t in turns]
    frame = spark.createDataFrame(data, SIDES)
    got = {r.pair_id: r for r in chat.assemble(chat.preference_segments(frame)).collect()}
    for p, (a, b) in pairs.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1

        def text(turns):
            return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for _, r, t in turns)

        def trained(whole, mask):
            return "".join(whole[m.start:m.end] for m in mask or ())

        r = got[p]
        assert (r.prompt, r.chosen, r.rejected) == (text(a[:n]), text(a[n:]), text(b[n:]))
        for turns, whole, mask in ((a[n:], r.chosen, r.chosen_mask), (b[n:], r.rejected, r.rejected_mask)):
            assert trained(whole, mask) == "".join(f"{t or ''}<|end|>\n" for _, x, t in turns if x == "assistant")


def test_longest_common_prefix(spark):
    u, s = (0, "user", "hi"), (-1, "system", "be brief")
    check(spark, {
        1: ([s, u, (1, "assistant", "a")], [s, u, (1, "assistant", "b")]),
        2: ([u, (1, "assistant", "a"), (2, "user", "x"), (3, "assistant", "long")],
            [u, (1, "assistant", "other"), (2, "user", "x"), (3, "assistant", "long")]),
        3: ([u, (1, "assistant", "same")], [u, (1, "assistant", "same")]),
        4: ([(0, "user", "p")], [(0, "user", "q")]),
        5: ([u, (1, "assistant", "a")], [u]),
        6: ([u, (1, None, None), (2, "assistant", None)], [u, (1, None, None), (2, "assistant", "")]),
        7: ([(0, "user", "x"), (1, "assistant", "ü𝒳")], [(0, "assistant", "x"), (1, "assistant", "ü𝒳")]),
    })


def test_nulls_repeats_and_empty_tables(spark):
    data = [(None, "chosen", None, "user", "a"), (None, "rejected", None, "user", "a"),
            (None, "chosen", 0, "assistant", "b"), (None, "rejected", 0, "assistant", "c"),
            (1, "chosen", 0, "user", "a"), (1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "a")]
    got = chat.preference_segments(spark.createDataFrame(data, SIDES)).select("pair_id", "part", "rendered")
    parts = [(r.pair_id, r.part) for r in got.collect()]
    assert sorted(parts, key=repr) == sorted([(None, "prompt"), (None, "chosen"), (None, "rejected"),
                                              (1, "chosen"), (1, "chosen"), (1, "rejected")], key=repr)
    assert chat.preference_segments(spark.createDataFrame([], SIDES)).collect() == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.borrowed_replies(empty).collect() == []


def test_every_turn_is_kept_and_replies_are_borrowed(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    sides = chat.borrowed_replies(frame)
    assert rows(sides.filter("side = 'chosen'").select("pair_id", "turn", "role", "text")) == rows(frame)
    talks = {}
    for r in frame.orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    last = {c: max((t for t in turns if t[1] == "assistant"), default=None) for c, turns in talks.items()}
    rejected = {}
    for r in sides.filter("side = 'rejected'").orderBy("pair_id", "turn").collect():
        rejected.setdefault(r.pair_id, []).append((r.turn, r.role, r.text))
    lent = []
    for c, turns in talks.items():
        if last[c] is None:
            assert rejected[c] == turns
            continue
        assert rejected[c][:-1] == [t for t in turns if t[0] < last[c][0]]
        turn, role, reply = rejected[c][-1]
        assert (turn, role) == (last[c][0], "assistant")
        lent.append(reply)
    # every last reply is lent once, and almost none to its own conversation
    assert sorted(lent) == sorted(t[2] for t in last.values() if t)
    assert sum(rejected[c][-1][2] == t[2] for c, t in last.items() if t) <= 1
    check(spark, {c: (talks[c], rejected[c]) for c in list(talks)[:40]})


def test_a_hot_opening_and_lone_conversations(spark):
    data = [(c, t, r, "same opening" if t == 0 else f"{c} {t}") for c in range(300)
            for t, r in ((0, "user"), (1, "assistant"))] + [(900, 0, "user", "no reply")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.preference_segments(chat.borrowed_replies(frame))
    assert got.filter("part = 'prompt'").count() == 301
    assert got.filter("part = 'chosen'").count() == got.filter("part = 'rejected'").count() == 300
    one = frame.filter("conv_id = 3")
    assert [r.part for r in chat.preference_segments(chat.borrowed_replies(one)).collect()] == ["prompt"] * 2
