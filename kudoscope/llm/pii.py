"""Personal data: fixed patterns, and identifiers found from the contexts they stand in.

The fixed patterns give the base spans and, with them, seed entities. Two words to the
left or to the right of an identifier are a lexical pattern, and so is one word to the
left that ends as labels do (``email:``, ``ref=``, ``no.#``). Patterns and instances
form a graph. A pattern is as good as the share of known instances among those it
meets, an instance as good as the patterns that meet it; both are scored in turns. What
a trusted pattern meets is a seed for others in the turns that follow. Patterns that
end up trusted give further spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kudoscope.functions.columns import compute_once
from kudoscope.llm import common
from kudoscope.session import materialise

# What is searched for. Repeated groups are possessive: nothing follows
# them that they could give back, and a run of characters in which no match starts at
# the first (or where the last match ended) is not tried again, so the matches are
# those of the plain patterns, in linear time and without recursion.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
FOUND = "id"          # kind of the spans that the patterns add
ROUNDS = 4
PRIOR = 1.0           # unknown instances that every pattern is charged with
MIN_SEEDS = 3         # seeds that a trusted pattern meets at least
MIN_SHARE = 0.5       # share of its instances that are seeds, so that turns alone make no pattern trusted
MIN_CONFIDENCE = 0.8
LONG = 200            # code points from which a context is named by its digest, whole words all the same
_NOT_SPACE, _SPACE = "[^\\x09-\\x0D\\x20]", "[\\x09-\\x0D\\x20]"
CANDIDATE = f"(?<!{_NOT_SPACE})[^\\x09-\\x0D\\x200-9@]*+[0-9@]{_NOT_SPACE}*+"
_SPANS = "array<struct<start:int,end:int,match:string>>"


def _offsets(matches: Column, gaps: Column) -> Column:
    """Start, end and text of each match, from the text between the matches."""
    lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
    spans = common.let(common.sums_before(lengths), lambda before: F.transform(
        matches, lambda m, i: F.struct(
            (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
            (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"), m.alias("match"))))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_SPANS))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """12 to 19 digits that pass the check; every second one from the right counts double."""
    def passes(number: Column) -> Column:
        n = F.length(number)

        def add(total: Column, i: Column) -> Column:
            digit = F.substring(number, i, F.lit(1)).cast("int")
            twice = F.pmod(n - i, F.lit(2)) == 1
            return total + F.when(twice, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
        return F.when(n.between(12, 19), F.pmod(total, F.lit(10)) == 0).otherwise(False)

    return common.let(_digits(match), passes)


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) > 3, False).otherwise(F.concat(F.lit("0"), bare).cast("int") <= 255)

    return F.forall(F.split(match, "\\."), small)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
# A cheap test that every match passes, so that most texts are not searched.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit("[0-9]\\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit("[0-9][0-9 -]{10}")),
    "phone": lambda t: F.rlike(t, F.lit("\\+[0-9]")),
}


def _matches(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of raw matches ``_email, _ip, _card, _phone`` and ``_cand``."""
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    found = {f"_{k}": F.when(_HINT[k](text), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(none)
             for k, p in PATTERNS.items()}
    found["_cand"] = F.when(F.rlike(text, F.lit("[0-9@]")),
                            F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).otherwise(none)
    # what stands between the matches, once per text and only where there are any
    docs = compute_once(docs, **found)
    return compute_once(docs, **{f"{c}_gaps": F.when(F.size(c) > 0, F.split(text, p, -1)).otherwise(none)
                                 for c, p in [*((f"_{k}", p) for k, p in PATTERNS.items()), ("_cand", CANDIDATE)]})


def _spans(kind: str) -> Column:
    """Valid spans of a kind: ``start, rank, kind, end, match``."""
    located = _offsets(F.col(f"_{kind}"), F.col(f"_{kind}_gaps"))
    valid = F.filter(located, lambda s: _VALID[kind](s["match"]))
    return F.transform(valid, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
        s["end"].alias("end"), s["match"].alias("match")))


def _contexts(gap: Column, after: Column) -> dict[str, Column]:
    """Patterns of a word between two gaps: the two words before it, the label before it, the two words after it.

    Lower-cased whole words; null where the gap has fewer or its last word is no label.
    The words before are read backwards, so that no place in a gap is looked at twice.
    """
    two = f"^{_SPACE}*+({_NOT_SPACE}++{_SPACE}++{_NOT_SPACE}++)"
    back = F.reverse(gap)

    def named(side: str, words: Column) -> Column:
        plain = F.regexp_replace(F.lower(words), f"{_SPACE}+", " ")
        short = F.when(F.length(plain) >= LONG, F.sha2(plain, 256)).otherwise(plain)
        return F.when(F.length(plain) > 0, F.concat(F.lit(side), short))

    return {"before": named("L ", F.reverse(F.regexp_extract(back, two, 1))),
            "label": named("W ", F.reverse(F.regexp_extract(back, f"^{_SPACE}*+([:=#]{_NOT_SPACE}*+)", 1))),
            "after": named("R ", F.regexp_extract(after, two, 1))}


def _occurrences() -> Column:
    """Words that hold a digit or an at sign, each with its place and its contexts."""
    gaps = F.col("_cand_gaps")
    located = _offsets(F.col("_cand"), gaps)
    return F.transform(located, lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        *[c.alias(n) for n, c in _contexts(F.get(gaps, i), F.get(gaps, i + 1)).items()]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, words`` per row: base spans by start and kind, and the
    words that could be identifiers. One pass over the texts, which go no further."""
    found = _matches(docs.select("doc_id", "text"))
    base = reduce(F.concat, [_spans(k) for k in KINDS])
    return found.select("doc_id", common.text_key(F.col("text")).alias("text_key"),
                        F.sort_array(base).alias("base"), _occurrences().alias("words"))


def occurrences(scanned: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, end, instance, known, pattern``: a row per word and context.

    A word at which a base span starts stands for that span and is known; a word
    inside a span is no occurrence. Others keep what is between their first and last
    letter, digit or at sign, and are left out if there is no letter or digit. Words
    and spans are met by sorting both along each text.
    """
    text = ["doc_id", "text_key"]
    span = F.struct("start", "end", "match")
    spans = (scanned.select(*text, F.explode("base").alias("s")).select(*text, "s.start", "s.end", "s.match")
             .withColumns({c: F.lit(None).cast("string") for c in ("before", "label", "after")})
             .withColumns({"is_span": F.lit(1), "span": span}))
    words = (scanned.select(*text, F.explode("words").alias("w")).select(*text, "w.*")
             .withColumns({"is_span": F.lit(0), "span": F.lit(None).cast("struct<start:int,end:int,match:string>")}))
    # at one place the word comes before the span, from either end
    onward = Window.partitionBy(*text).orderBy("start", "is_span").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*text).orderBy(F.desc("start"), F.desc("is_span")).rowsBetween(
        Window.unboundedPreceding, 0)
    core = F.regexp_extract("match", "^[^\\p{L}\\p{N}@+]*+(.*?)[^\\p{L}\\p{N}@]*$", 1)
    lead = F.length(F.regexp_extract("match", "^([^\\p{L}\\p{N}@+]*+)", 1))
    met = (words.unionByName(spans)
           .withColumns({"reach": F.max(F.col("span.end")).over(onward),
                         "opens": F.last("span", ignorenulls=True).over(back)})
           .filter("is_span = 0")
           .withColumns({"known": F.coalesce(F.col("opens.start") < F.col("end"), F.lit(False)),
                         "core": core, "from": F.col("start") + lead})
           .filter(F.col("known") | (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
                                     & F.col("core").rlike("[\\p{L}\\p{N}]"))))
    one_word = F.col("opens.end") <= F.col("end")
    contexts = F.array_compact(F.array("before", "label", F.when(~F.col("known") | one_word, F.col("after"))))
    return met.select(
        *text, F.col("from").alias("start"), (F.col("from") + F.length("core")).alias("end"),
        F.when(F.col("known"), F.col("opens.match")).otherwise(F.col("core")).alias("instance"),
        "known", F.explode(contexts).alias("pattern"))


def score_patterns(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE,
                   min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``pattern, confidence, seeds, trusted`` after some turns of scoring patterns and instances.

    Edges are distinct before the first turn, so repeats and copies weigh nothing. A
    pattern's confidence is the mean score of its instances, with PRIOR unknown ones
    added; an unknown instance scores ``1 - prod(1 - confidence)`` over its patterns
    that met a seed. Seeds are the known instances and those that a trusted pattern met
    in an earlier turn; a pattern is trusted if its confidence, its seeds and their
    share suffice. Each turn is two aggregates and two joins on the edge table, whose
    heavy keys Spark splits; nothing is gathered per pattern.
    """
    edges = found.groupBy("pattern", "instance").agg(F.max(F.col("known").cast("int")).alias("known"))
    edges = materialise(edges, "pii-edges")
    known = edges.groupBy("instance").agg(F.max("known").alias("is_known"))
    scores = materialise(known.select("instance", "is_known", F.col("is_known").alias("is_seed"),
                                      F.col("is_known").cast("double").alias("score")), "pii-instances")
    patterns = None
    for turn in range(rounds):
        met = edges.select("pattern", "instance").join(scores, "instance")
        scored = met.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("confidence"),
            F.sum("is_seed").alias("seeds"), F.count(F.lit(1)).alias("instances"))
        trusted = ((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds)
                   & (F.col("seeds") >= MIN_SHARE * F.col("instances")))
        patterns = materialise(scored.select("pattern", "confidence", "seeds", trusted.alias("trusted")), "pii-patterns")
        if turn < rounds - 1:
            doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
            inferred = (edges.select("pattern", "instance")
                        .join(patterns.filter("seeds > 0").select("pattern", "confidence", "trusted"), "pattern")
                        .groupBy("instance").agg((1 - F.exp(doubt)).alias("inferred"),
                                                 F.max(F.col("trusted").cast("int")).alias("by_trusted")))
            scores = materialise(scores.drop("score").join(inferred, "instance", "left").select(
                "instance", "is_known", F.greatest("is_seed", F.coalesce("by_trusted", F.lit(0))).alias("is_seed"),
                F.when(F.col("is_known") == 1, 1.0).otherwise(F.coalesce("inferred", F.lit(0.0))).alias("score")),
                "pii-instances")
    return patterns


def find(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS,
         rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text_key, base, spans`` per row of ``docs`` (doc_id, text).

    ``base`` holds the spans of the fixed patterns as ``start, rank, kind, end, match``;
    ``spans`` adds those found by context, kind ``id``, ordered by start, then by kind as
    listed, ``id`` last. Offsets are code points, ends exclusive. A null or empty text
    has no spans; rows that repeat give as many rows with equal spans; a null doc_id is
    a document like any other; an empty table gives an empty result; other columns are
    not read. Matches that fail their test are dropped and not tried again.
    """
    scanned = materialise(scan(docs), "pii-scan")
    found = materialise(occurrences(scanned), "pii-occurrences")
    trusted = score_patterns(found, rounds, min_confidence, min_seeds).filter("trusted").select("pattern")
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(FOUND).alias("kind"), "end",
                    F.col("instance").alias("match"))
    added = (found.filter("not known").join(trusted, "pattern")
             .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
             .agg(F.collect_set(span).alias("added")))
    added = materialise(added, "pii-added")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,match:string>>")
    return (scanned.join(added, scanned["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
            .select("doc_id", "text_key", "base",
                    F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; n_chars follows the text.

    Where spans overlap, the first one's name stands for both. Texts without spans and
    null texts stay as they are; all columns and rows stay.
    """
    found = find(docs, **options).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans").dropDuplicates(["id", "key"])
    found = materialise(found, "pii-redact")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]),
                                       F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(
        acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", common.text_key(F.col("text")).alias("text_key"))
    met = (rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
           .withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row")["n_chars"]).otherwise(length)
    return met.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with counts, a digest of its base spans, and all spans."""
    found = find(common.table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
