"""Text functions. All are Column -> Column and run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kudoscope.functions.columns import let

# ---------------------------------------------------------------- fixed values
# Contractions spelled out before punctuation goes, so the negation survives.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "can't": "cannot", "couldn't": "could not", "won't": "will not",
    "wouldn't": "would not", "aren't": "are not", "isn't": "is not",
    "wasn't": "was not", "weren't": "were not", "hasn't": "has not",
    "haven't": "have not", "hadn't": "had not", "shouldn't": "should not",
    "mightn't": "might not", "mustn't": "must not",
}

# Common English stopword list, entries without an apostrophe (the cleaner has
# removed apostrophes by the time it looks words up).
ENGLISH_STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren
won wouldn
""".split())

# Words that carry negation or modality and stay in the text.
KEPT_WORDS = (
    "no", "not", "nor", "against", "but",
    "do", "does", "did", "is", "are", "was", "were",
    "has", "have", "had", "should", "could", "would",
    "might", "must", "can", "will",
)
# ------------------------------------------------------------ end fixed values

REMOVED_WORDS = tuple(w for w in ENGLISH_STOPWORDS if w not in KEPT_WORDS)

# Whitespace as Unicode sees it; Java's own \s is ASCII only.
_SPACES = (r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
           r"\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}")
SPACE = f"[{_SPACES}]"
NON_SPACE = f"[^{_SPACES}]"


def lower_text(text: Column) -> Column:
    """Lower case; null becomes the empty string."""
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def trim_spaces(text: Column) -> Column:
    """Trim any Unicode whitespace at both ends.

    Most texts need no trim, which their first and last character show. The
    lookbehind makes a long run of spaces inside a text cost its length, once.
    """
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    trimmed = F.regexp_replace(text, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}++\z", "")
    return F.when(ends.rlike(SPACE), trimmed).otherwise(text)


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(text.rlike(NON_SPACE), F.lit(False))


def strip_html(text: Column) -> Column:
    """Replace tags by a space.

    Only the part up to the last ``>`` can hold a tag. Leaving the rest alone keeps
    texts with many unclosed ``<`` linear.
    """
    rest = F.substring_index(text, ">", -1)
    head = F.left(text, F.length(text) - F.length(rest))
    return F.when(F.contains(text, F.lit("<")),
                  F.concat(F.regexp_replace(head, "<[^>]+>", " "), rest)).otherwise(text)


def strip_urls(text: Column) -> Column:
    """Drop everything from ``http`` or ``www`` to the next space, also inside words."""
    some = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    return F.when(some, F.regexp_replace(text, f"(?:http|www){NON_SPACE}+", " ")).otherwise(text)


def expand_contractions(text: Column) -> Column:
    """Spell out negated contractions (straight apostrophe only)."""
    spelled = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])),
                     CONTRACTIONS.items(), text)
    # most texts hold no "n't": one scan then replaces seventeen
    return F.when(F.contains(text, F.lit("n't")), spelled).otherwise(text)


def normalise_letters(text: Column) -> Column:
    """Keep a-z, one space between words, no space at the ends."""
    return F.trim(F.regexp_replace(text, "[^a-z]+", " "))


def remove_stopwords(text: Column) -> Column:
    """Drop stopwords; order and repeats of the other words stay."""
    words = F.filter(F.split(text, " "), lambda w: ~w.isin(*REMOVED_WORDS))
    return F.array_join(words, " ")


def clean_text(text: Column) -> Column:
    """The full cleaner used before deduplication, training and scoring.

    Each step names the text before it several times, so it is handed on by ``let``. Splitting
    at what is no letter gives the words that ``normalise_letters`` leaves.
    """
    plain = let(lower_text(text), lambda t: let(strip_html(t), lambda u: let(strip_urls(u), expand_contractions)))
    words = F.filter(F.split(plain, "[^a-z]+"), lambda w: ~w.isin("", *REMOVED_WORDS))
    return F.array_join(words, " ")


def combined_text(text: Column, title: Column) -> Column:
    """Body and title as one trimmed string."""
    both = F.concat(trim_spaces(F.coalesce(text, F.lit(""))), F.lit(" "),
                    trim_spaces(F.coalesce(title, F.lit(""))))
    return let(both, trim_spaces)


def hashed_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` + 16 hex digits of the SHA-256 of the parts joined by ``_``."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, 16))


def review_id(user: Column, product: Column, epoch_ms: Column, text: Column) -> Column:
    return hashed_id("rev_", user, product, F.coalesce(epoch_ms, F.lit(0)), text)


def place_review_id(place: Column, author: Column, text: Column) -> Column:
    return hashed_id("g_", place, author, text)


def epoch_ms_to_utc(epoch_ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss`` UTC; 0 and null give ''."""
    stamp = F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(epoch_ms, F.lit(0)) == 0, F.lit("")).otherwise(stamp)


def snippet(text: Column, length: int = 280, tail: str = "…", always: bool = False) -> Column:
    """First ``length`` characters; ``tail`` marks a cut (or every row when ``always``)."""
    head = F.substring(text, 1, length)
    if always:
        return F.concat(head, F.lit(tail))
    return F.when(F.length(text) > length, F.concat(head, F.lit(tail))).otherwise(text)


def html_escape(text: Column) -> Column:
    """Escape the five HTML specials, ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                      ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda t: t != ""))


def words(clean: Column) -> Column:
    """Model tokens of cleaned text: runs of two or more word characters."""
    return F.filter(F.split(clean, " "), lambda w: F.length(w) >= 2)


def ngrams(tokens: Column) -> Column:
    """Single words followed by adjacent pairs."""
    def with_pairs(t: Column) -> Column:
        pairs = F.when(
            F.size(t) >= 2,
            F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b)),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(t, pairs)

    return let(tokens, with_pairs)


_WORD = r"\p{L}\p{N}_"


def attribution_tokens(text: Column) -> Column:
    """Words, single punctuation marks and whitespace runs, in order, nothing lost."""
    pattern = f"[{_WORD}]+|[^{_WORD}{_SPACES}]|{SPACE}+"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
