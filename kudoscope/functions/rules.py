"""Rule intelligence: aspects, issue, priority and suggested action of a review.

Matching is by substring, so ``late`` is found inside ``chocolate``. All keyword
groups are looked up in ONE scan of the text: a single lookahead pattern reports,
for every position, the longest keyword that starts there. A keyword group is hit
when any reported keyword starts with one of its members.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kudoscope.functions.columns import compute_once
from kudoscope.functions.text import lower_text

# ---------------------------------------------------------------- fixed values
ASPECT_KEYWORDS = {
    "Product Quality": (
        "quality", "defect", "defective", "broke", "broken", "durability", "durable",
        "material", "cheaply", "smell", "scent", "fragrance", "texture", "formula",
        "allergic", "rash", "irritation", "burn", "reaction", "greasy", "sticky",
        "effective", "hydrat", "smooth", "soft", "shine", "moisture", "works well", "results"),
    "Delivery": (
        "deliver", "delivery", "shipping", "shipped", "arrived", "late", "delay",
        "delayed", "carrier", "transit", "received", "days", "weeks", "lost", "missing package"),
    "Packaging": (
        "packaging", "bottle", "pump", "cap", "seal", "unsealed", "leak", "leaking",
        "spill", "spray", "jar", "container", "crushed", "broken bottle", "dispenser"),
    "Customer Service": (
        "customer service", "support", "refund", "return", "returned", "seller",
        "contact", "response", "reply", "replace", "replacement", "warranty", "policy"),
    "Price & Value": (
        "price", "expensive", "overpriced", "cost", "cheap", "worth", "money",
        "value", "dollar", "affordable", "deal", "waste of money", "rip off", "bargain"),
    "Usability & Application": (
        "easy to use", "hard to use", "difficult", "application", "apply", "instructions",
        "heavy", "absorb", "absorption", "messy", "clean"),
    "Performance": (
        "perform", "performance", "long lasting", "hold", "coverage", "fade", "lifespan"),
}

# (aspect, issue, keywords); the first rule that matches wins.
ISSUE_RULES = (
    ("Delivery", "Shipping Delay",
     ("late", "delay", "delayed", "took weeks", "never arrived", "slow shipping")),
    ("Delivery", "Damaged in Transit",
     ("damaged package", "crushed box", "battered", "transit damage")),
    ("Packaging", "Defective Pump / Dispenser",
     ("pump broke", "pump doesn't work", "cannot spray", "clogged pump", "dispenser")),
    ("Packaging", "Leaking / Broken Seal",
     ("leaked", "leaking", "spilled", "seal broken", "unsealed", "open cap")),
    ("Product Quality", "Adverse Skin Reaction",
     ("rash", "allergic", "reaction", "burn", "burning", "breakout", "itchy", "irritation")),
    ("Product Quality", "Poor Formula Quality",
     ("cheap", "poor quality", "useless", "terrible", "waste of money", "did not work",
      "awful smell", "expired")),
    ("Product Quality", "High Quality & Efficacy",
     ("great quality", "fantastic", "amazing results", "soft skin", "love the smell",
      "works wonders")),
    ("Customer Service", "Unresponsive Support",
     ("no response", "never replied", "ignored", "bad service", "rude")),
    ("Customer Service", "Return / Refund Friction",
     ("refused refund", "cannot return", "return hassle", "no refund")),
    ("Price & Value", "Overpriced / Low Value",
     ("overpriced", "not worth the money", "too expensive", "waste of money")),
    ("Price & Value", "Great Value for Money",
     ("great price", "great value", "worth every penny", "affordable", "bargain")),
)

SEVERE_TERMS = ("rash", "allergic", "burn", "broken", "danger", "terrible", "leaked",
                "fraud", "never arrived")
REACTION_TERMS = ("rash", "burn", "allergic")

DEFAULT_ASPECT = "Product Quality"
NO_ASPECT = "General"
DEFAULT_ISSUE = "General Feedback"

NEGATIVE_ACTIONS = {
    "Delivery": "Audit carrier logistics & fulfillment time to reduce transit delays.",
    "Packaging": "Inspect bottle cap sealing integrity and pump mechanism quality.",
    "Customer Service":
        "Streamline customer support response protocol and return processing.",
    "Price & Value":
        "Review pricing tier positioning and emphasize cost-benefit value propositions.",
}
REACTION_ACTION = "Escalate to QA team to audit batch formulation and allergen warnings."
NEGATIVE_ACTION = "Review recurring product quality complaints and conduct batch inspection."
POSITIVE_ACTIONS = {
    "Product Quality": "Leverage high customer praise in brand testimonials and ad creatives.",
    "Price & Value": "Promote high-value bundles and customer loyalty rewards.",
}
POSITIVE_ACTION = "Maintain consistent quality standards and inventory fulfillment."
NEUTRAL_ACTION = "Monitor feedback trends for emerging customer sentiment shifts."
# ------------------------------------------------------------ end fixed values

ALL_KEYWORDS = tuple(sorted(
    {k for group in ASPECT_KEYWORDS.values() for k in group}
    | {k for _, _, group in ISSUE_RULES for k in group}
    | set(SEVERE_TERMS) | set(REACTION_TERMS)))


def _prefix_pattern(words: list[str], fan_out: int = 5) -> str:
    """Regex for the longest of ``words`` at a position, common prefixes factored out.

    A wide branching is grouped behind letter classes, which rejects most
    positions after a few checks instead of one per first letter.
    """
    if words == [""]:
        return ""
    by_first: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    branches = [(c, re.escape(c) + _prefix_pattern(rest)) for c, rest in by_first.items()]
    if len(branches) == 1 and "" not in words:
        return branches[0][1]
    if len(branches) > fan_out:
        groups = [branches[i:i + fan_out] for i in range(0, len(branches), fan_out)]
        options = [f"(?=[{''.join(c for c, _ in g)}])(?:{'|'.join(p for _, p in g)})"
                   for g in groups]
    else:
        options = [p for _, p in branches]
    return f"(?:{'|'.join(options)})" + ("?" if "" in words else "")


KEYWORD_SCAN = f"(?=({_prefix_pattern(list(ALL_KEYWORDS))}))"


def keyword_hits(lowered: Column) -> Column:
    """Distinct longest keywords found anywhere in already lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(KEYWORD_SCAN), F.lit(1)))


def _hit(hits: Column, group: tuple[str, ...]) -> Column:
    reported = [k for k in ALL_KEYWORDS if k.startswith(group)]
    return F.arrays_overlap(hits, F.array(*[F.lit(k) for k in reported]))


def _detected(hits: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(_hit(hits, group), F.lit(aspect)) for aspect, group in ASPECT_KEYWORDS.items()]))


def _first_rule(hits: Column, field: int) -> Column:
    out = None
    for rule in ISSUE_RULES:
        out = (F if out is None else out).when(_hit(hits, rule[2]), F.lit(rule[field]))
    return out


def is_negative(sentiment: Column, rating: Column) -> Column:
    return F.coalesce(F.lower(sentiment) == "negative", F.lit(False)) \
        | F.coalesce(rating <= 2, F.lit(False))


def is_positive(sentiment: Column, rating: Column) -> Column:
    return F.coalesce(F.lower(sentiment) == "positive", F.lit(False)) \
        | F.coalesce(rating >= 4, F.lit(False))


def _by_aspect(primary: Column, actions: dict[str, str], default: Column) -> Column:
    out = default
    for aspect, action in actions.items():
        out = F.when(primary == aspect, F.lit(action)).otherwise(out)
    return out


def with_intelligence(df: DataFrame, text: str = "text", sentiment: Column | None = None,
                      rating: Column | None = None) -> DataFrame:
    """Add ``primary_aspect, all_aspects, issue, priority, suggested_action`` to a table.

    Narrow, no shuffle. The text is scanned once per row, however many rules and
    later filters read the result.
    """
    sentiment = F.col("sentiment") if sentiment is None else sentiment
    rating = F.col("rating") if rating is None else rating
    negative, positive = is_negative(sentiment, rating), is_positive(sentiment, rating)
    hits = F.col("_hits")
    scanned = compute_once(df, _hits=keyword_hits(lower_text(F.col(text))))
    found = scanned.withColumns({
        "_detected": _detected(hits),
        "_rule_aspect": _first_rule(hits, 0),
        "issue": F.coalesce(_first_rule(hits, 1), F.lit(DEFAULT_ISSUE)),
        "_severe": _hit(hits, SEVERE_TERMS),
        "_reaction": _hit(hits, REACTION_TERMS),
    })
    detected, rule_aspect = F.col("_detected"), F.col("_rule_aspect")
    found = found.withColumns({
        "primary_aspect": F.coalesce(rule_aspect, F.try_element_at(detected, F.lit(1)),
                                     F.lit(DEFAULT_ASPECT)),
        "all_aspects": F.when(rule_aspect.isNotNull() & ~F.array_contains(detected, rule_aspect),
                              F.concat(F.array(rule_aspect), detected))
                        .when(F.size(detected) == 0, F.array(F.lit(NO_ASPECT)))
                        .otherwise(detected),
        "priority": F.when(negative & F.col("_severe"), "HIGH")
                     .when(negative, "MEDIUM").otherwise("LOW"),
    })
    primary = F.col("primary_aspect")
    reaction = F.contains(F.col("issue"), F.lit("Reaction")) | F.col("_reaction")
    action = (F.when(negative, _by_aspect(
                  primary, NEGATIVE_ACTIONS,
                  F.when(reaction, F.lit(REACTION_ACTION)).otherwise(F.lit(NEGATIVE_ACTION))))
              .when(positive, _by_aspect(primary, POSITIVE_ACTIONS, F.lit(POSITIVE_ACTION)))
              .otherwise(F.lit(NEUTRAL_ACTION)))
    return (found.withColumn("suggested_action", action)
            .drop("_hits", "_detected", "_rule_aspect", "_severe", "_reaction"))
