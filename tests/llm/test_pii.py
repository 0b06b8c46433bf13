"""Personal data: base spans against plain regular expressions, and the bootstrapping."""

import hashlib
import math
import re
from collections import defaultdict

from llm_cases import docs, none, odd  # noqa: F401

from kudoscope.llm import pii

# The patterns as the task words them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def check(frame):
    got = pii.find(frame).select("doc_id", pii.listed(pii.F.col("base")).alias("b"),
                                 pii.listed(pii.F.col("spans")).alias("s")).collect()
    want = [(r.doc_id, listed(base(r.text))) for r in frame.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.b) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert set(filter(None, r.b.split(","))) <= set(filter(None, r.s.split(",")))
    return got


def test_given_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


HARD = ["a@b.c_d@e.f-g.h", "x@y", "@a.b", "a@b..c", "a.b%c+d@h-i.jk.", "é𝒳 me@site.org, 10.0.0.1!",
        "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0255.0", "999999999999999999999999.1.1.1", "1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111", "card 4111111111111112 no", "0" * 12,
        "+1 (017) 555-7713 9807915762804490", "+49.170 1234567.", "+1", "+12 345", "tel+442071234567x", "+1(2)3-4.5 6789 0123456789",
        "x" * 9_000 + " a@b.c", "7" * 5_000 + " 1.2.3.4 " + "7" * 5_000, "a@b.c" + "x@" * 2000,
        "7" * 5000, "1 2" * 3000, "a." * 4000 + "@b.c", "1.1." * 3000, "+1" + "(" * 3000, "a@b" + ".c" * 5000, ""]


def test_hard_texts(spark):
    check(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"))


def test_odd_rows(odd, none):
    check(odd)
    assert pii.find(none).collect() == []


def member_table(spark):
    rows = [(i, f"our member id is {mail} since long ago") for i, mail in enumerate(
        [f"user{i}@mail.example.org" for i in range(12)])]
    rows += [(100 + i, f"and the member id is ({code}), since long ago") for i, code in enumerate(
        ["QX-4471-Z", "TT-9020-A", "QX-1111-B"])]
    rows += [(200 + i, f"in the year of {1900 + i}42 it rained") for i in range(9)]
    rows += [(300 + i, f"in the year of 10.0.0.{i} it rained") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_identifiers(spark):
    frame = member_table(spark)
    texts = {r.doc_id: r.text for r in frame.collect()}
    added = {}
    for r in pii.find(frame).collect():
        added[r.doc_id] = [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "id"]
    assert [added[100], added[101], added[102]] == [["QX-4471-Z"], ["TT-9020-A"], ["QX-1111-B"]]
    assert not any(v for d, v in added.items() if d not in (100, 101, 102))


def test_scores_against_plain_python(spark):
    edges = [("p", f"k{i}", True) for i in range(8)] + [("p", "u", False), ("q", "u", False), ("q", "k0", True),
             ("r", "u", False), ("r", "v", False)]
    frame = spark.createDataFrame([e + e[1:1] for e in edges + edges[:3]], "pattern string, instance string, known boolean")
    got = {r.pattern: r.confidence for r in pii.score_patterns(frame, rounds=2).collect()}
    first = {"p": 8 / 10, "q": 1 / 3}
    u = 1 - (1 - first["p"]) * (1 - first["q"])
    want = {"p": (8 + u) / 10, "q": (1 + u) / 3, "r": u / 3}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_redaction(spark, odd):
    frame = member_table(spark).withColumn("n_chars", pii.F.length("text"))
    got = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert got[0].text == "our member id is [EMAIL] since long ago"
    assert got[100].text == "and the member id is ([ID]), since long ago"
    assert got[301].text == "in the year of [IP] it rained" and got[301].n_chars == len(got[301].text)
    assert pii.redact(odd).columns == odd.columns
    assert sorted(map(repr, pii.redact(odd).collect())) == sorted(map(repr, odd.collect()))


def test_digest_columns(spark):
    got = pii.op3_pii(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got.collect():
        spans = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in PLAIN]


def twin(rows, rounds=pii.ROUNDS):
    """The added spans of each document, all in plain Python: ``{doc_id: {(start, end), ...}}``."""
    met = []
    for doc, text in rows:
        spans = [(s, e) for s, _, _, e in base(text)]
        words = [m.span() for m in re.finditer(r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x20]*[0-9@][^\x09-\x0D\x20]*", text or "")]
        for i, (a, b) in enumerate(words):
            left = text[words[i - 1][1] if i else 0:a].lower()
            right = text[b:words[i + 1][0] if i + 1 < len(words) else len(text)].lower()
            left, right = (re.findall(r"[^\x09-\x0D\x20]+", x) for x in (left, right))
            opened = min((s for s in spans if s[0] >= a), default=None)
            known = opened is not None and opened[0] < b
            core = re.search(r"^[^\w@+]*(.*?)[^\w@]*$", text[a:b].replace("_", "-"))
            if not known and (any(s < a < e for s, e in spans) or not re.search(r"\w", core[1])):
                continue
            names = ["L " + " ".join(left[-2:])] if len(left) > 1 else []
            if left and left[-1][-1] in ":=#":
                names.append("W " + left[-1])
            if len(right) > 1 and (not known or opened[1] <= b):
                names.append("R " + " ".join(right[:2]))
            instance = text[slice(*opened)] if known else text[a + core.start(1):a + core.end(1)]
            met += [(doc, a + core.start(1), a + core.end(1), instance, known, n) for n in names]
    edges = {(n, i) for *_, i, _, n in met}
    sure = {i for *_, i, k, _ in met if k}
    seeds, score = set(sure), {i: float(i in sure) for _, i in edges}
    for _ in range(rounds):
        of = defaultdict(list)
        for n, i in edges:
            of[n].append(i)
        confidence = {n: sum(score[i] for i in x) / (len(x) + 1) for n, x in of.items()}
        hits = {n: sum(i in seeds for i in x) for n, x in of.items()}
        trusted = {n for n, x in of.items() if confidence[n] >= 0.8 and hits[n] >= 3 and hits[n] >= len(x) / 2}
        for i in score.keys() - sure:
            score[i] = 1 - math.prod(1 - min(confidence[n], 0.999999) for n, j in edges if j == i and hits[n])
        seeds |= {i for n in trusted for i in of[n]}
    out = defaultdict(set)
    for doc, a, b, _, known, n in met:
        if not known and n in trusted:
            out[doc].add((a, b))
    return dict(out)


def added(frame):
    got = pii.find(frame).select("doc_id", "spans").collect()
    return {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "id"} for r in got
            if any(s.kind == "id" for s in r.spans)}


def label_rows():
    """Mails and identifiers under one label, identifiers and others under a second, and mixed company."""
    rows = [f"contact: user{i}@mail.org" for i in range(60)]
    rows += [f"contact: QX-40{i:02}-Z" for i in range(20)]
    rows += [f"w{'abcdefghij'[i % 10]}x my ref= \"QX-40{i:02}-Z\", thanks" for i in range(20)]
    rows += ["so ref= A7", "thy ref= (B8-77).", "REF= C9"]
    rows += [f"paid: 10.0.0.{i}" for i in range(10)] + [f"paid: {i}99 coins" for i in range(30)]
    rows += [f"{'v' * 90}{i % 3} {'u' * 150}: m{i}@n.org" for i in range(9)] + [f"{'u' * 150}: K-{i}" for i in range(2)]
    return list(enumerate(rows))


def test_labels_and_inferred_seeds(spark):
    rows = label_rows()
    got, text = added(spark.createDataFrame(rows, "doc_id long, text string")), dict(rows)
    words = {d: [text[d][a:b] for a, b in sorted(x)] for d, x in got.items()}
    assert [words[60 + i] for i in range(20)] == [[f"QX-40{i:02}-Z"] for i in range(20)]
    assert [words[100], words[101], words[102]] == [["A7"], ["B8-77"], ["C9"]]
    assert words[len(rows) - 1] == ["K-1"]
    assert not any(text[d].startswith("paid") for d in got) and got == twin(rows)


def test_varying_words_before_a_label(spark):
    rows = [(d, f"word{'abcdefghijklmnopqrstuvwxyz'[d % 26]} {'abcdefg'[d % 7]} {t}") for d, t in label_rows()[:80]]
    frame = spark.createDataFrame([(d, re.sub("^word", "", t)) for d, t in rows], "doc_id long, text string")
    got = added(frame)
    assert sorted(got) == list(range(60, 80)) and got == twin([tuple(r) for r in frame.collect()])


def test_added_spans_against_plain_python(spark):
    frame = member_table(spark)
    assert added(frame) == twin([tuple(r) for r in frame.collect()])
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert added(given) == twin([tuple(r) for r in given.collect()])


def test_no_false_span_on_given_texts(spark):
    assert added(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == {}


def test_contexts_of_very_long_words(spark):
    long = "x" * 300_000
    rows = [(i, f"{long} {long}{i % 2}: a{i}@b.org") for i in range(4)] + [(9, f"{long} {long}: Q-1")]
    assert added(spark.createDataFrame(rows, "doc_id long, text string")) == {}
