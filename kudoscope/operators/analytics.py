"""Dashboard analytics: shares, trends, complaints, product indicators.

Every operator reduces the review table with map-side partial aggregates first and
works on the small result afterwards; windows only ever see aggregated rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.functions.labels import share_pct
from kudoscope.functions.rules import DEFAULT_ISSUE, with_intelligence
from kudoscope.operators.ranking import top_per_group
from kudoscope.schemas import LABELS

# ---------------------------------------------------------------- fixed values
NO_ISSUE = "General Complaints"
URGENT_ASPECTS = ("Product Quality", "Delivery")
URGENT_ISSUE_TERMS = ("reaction", "delay", "broken")
CRITICAL_ISSUE_TERMS = ("reaction", "rash", "burn", "delay", "broken", "leaked", "damage")
TIERS = ((35, "AVOID"), (55, "MIXED"), (80, "BUY"))
TOP_TIER = "TOP TIER"
NARRATIVES = {
    "two_concerns": "{a1} ({s1}) and {a2} ({s2})",
    "one_concern": "{a1}, accounting for {s1} of negative reviews (primarily {i1})",
    "praise": "Customer sentiment is exclusively favorable across {total} reviews ({positive} positive, "
              "{neutral} neutral) with zero negative complaints recorded in the dataset.",
    "mostly_good": "Customer sentiment is predominantly positive ({positive}). Negative feedback ({negative}, "
                   "{negative_count} reviews) is most concentrated around {phrase}.",
    "friction": "Negative feedback represents a substantial share ({negative}, {negative_count} reviews) for this "
                "product. Friction is primarily concentrated in {phrase}.",
    "balanced": "Customer feedback reflects a balanced distribution across {total} reviews ({positive} positive, "
                "{neutral} neutral, {negative} negative). Negative feedback is most concentrated in {phrase}.",
}
# ------------------------------------------------------------ end fixed values


# ------------------------------------------------------------------ shares
def class_distribution(df: DataFrame, column: str = "sentiment", rows: str | None = None) -> DataFrame:
    """``(sentiment, count, percentage)`` for all three classes, absent ones 0.

    ``rows`` names the column with the number of rows that a row stands for, if not one.
    """
    if rows is None:
        total = df.agg(F.count(column).alias("n"), *labels.class_counts(F.col(column)))
    else:
        hits = {"n": F.col(column).isNotNull(), **{c: F.col(column) == c for c in LABELS}}
        total = df.agg(*[F.coalesce(F.sum(F.when(hit, F.col(rows))), F.lit(0).cast("long")).alias(name)
                         for name, hit in hits.items()])
    return total.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("count"),
                 share_pct(F.col(c), F.col("n")).alias("percentage")) for c in LABELS])))


def rating_distribution(df: DataFrame, rows: str | None = None) -> DataFrame:
    """``(rating, count, percentage)`` ordered by star; ``rows`` as in ``class_distribution``."""
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counts = df.filter(F.col("rating").isNotNull()).groupBy("rating").agg(n.alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (counts.withColumn("percentage", share_pct(F.col("count"), total)).orderBy("rating"))


def sentiment_pulse(df: DataFrame) -> DataFrame:
    """One row: total, count and unrounded share of each class."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *labels.class_counts(F.col("sentiment")))
    return counts.select("total", *[F.col(c).alias(f"{c}_count") for c in LABELS],
                         *[share_pct(F.col(c), F.col("total")).alias(f"{c}_pct") for c in LABELS])


def label_counts(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """Rows per value of a low-cardinality column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def label_domain(df: DataFrame) -> DataFrame:
    """Distinct labels in order."""
    return (df.filter(F.col("sentiment").isNotNull()).select("sentiment").distinct()
            .orderBy("sentiment"))


def place_pulse(df: DataFrame, key: str = "place_id") -> DataFrame:
    """Per place: counts, one-decimal shares, mismatch count and share."""
    counts = df.groupBy(key).agg(
        F.count("sentiment").alias("total_reviews"),
        *[F.count_if(F.col("sentiment") == c).alias(f"{c}_count") for c in LABELS],
        F.count_if(labels.is_mismatch(F.col("rating"), F.col("sentiment"))).alias("mismatch_count"))
    total = F.col("total_reviews")
    return counts.withColumns({
        **{f"{c}_pct": F.round(share_pct(F.col(f"{c}_count"), total), 1) for c in LABELS},
        "mismatch_pct": F.round(share_pct(F.col("mismatch_count"), total), 1)})


def quarterly_trend(df: DataFrame) -> DataFrame:
    """Per calendar quarter: reviews, positives, positive share to one decimal."""
    stamp = F.col("date_dt")
    label = F.concat(F.year(stamp).cast("string"), F.lit("Q"), F.quarter(stamp).cast("string"))
    return (df.filter(stamp.isNotNull()).groupBy(label.alias("quarter"))
            .agg(F.count("sentiment").alias("total"),
                 F.count_if(F.lower("sentiment") == "positive").alias("positive"))
            .withColumn("pos_ratio", F.round(share_pct(F.col("positive"), F.col("total")), 1))
            .orderBy("quarter"))


def mismatch_summary(df: DataFrame) -> DataFrame:
    """One row: over-rated, under-rated, all mismatches and their rate."""
    rating, sentiment = F.col("rating"), F.col("sentiment")
    return (df.agg(F.count_if(labels.over_rated(rating, sentiment)).alias("over_rated"),
                   F.count_if(labels.under_rated(rating, sentiment)).alias("under_rated"),
                   F.count(F.lit(1)).alias("_n"))
            .withColumn("total_mismatches", F.col("over_rated") + F.col("under_rated"))
            .withColumn("mismatch_rate", share_pct(F.col("total_mismatches"), F.col("_n")))
            .drop("_n"))


# -------------------------------------------------------------- complaints
def _mentions(column: str, terms: tuple[str, ...]) -> Column:
    return F.lower(column).rlike("|".join(terms))


def negative_intelligence(df: DataFrame) -> DataFrame:
    """Intelligence of the negative reviews, polarity forced to negative."""
    return with_intelligence(df.filter(F.col("sentiment") == "negative"),
                             sentiment=F.lit("negative"))


def complaint_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per ``keys`` and primary aspect: count, high-priority count, top issue, first action.

    The first grouping keeps text values in its keys and only numbers in its
    buffers, so it stays a hash aggregate and shrinks inside each partition;
    what follows sees at most a few dozen rows per key. ``order`` must be numeric.
    """
    tagged = negative_intelligence(df).select(
        *keys, F.col("primary_aspect").alias("aspect"), "issue", "priority",
        F.col("suggested_action").alias("action"), F.col(order).alias("_order"))
    small = tagged.groupBy(*keys, "aspect", "issue", "priority", "action").agg(
        F.count(F.lit(1)).alias("n"), F.min("_order").alias("first"))
    issues = small.groupBy(*keys, "aspect", "issue").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("priority") == "HIGH", F.col("n")).otherwise(0)).alias("high"),
        F.min("first").alias("first"), F.min_by("action", "first").alias("action"))
    # most frequent issue, name breaks ties; generic feedback never wins
    weight = F.when(F.col("issue") != DEFAULT_ISSUE, F.struct(-F.col("n"), F.col("issue")))
    return issues.groupBy(*keys, "aspect").agg(
        F.sum("n").alias("count"), F.sum("high").alias("high_priority"),
        F.coalesce(F.min_by("issue", weight), F.lit(NO_ISSUE)).alias("issue"),
        F.min_by("action", "first").alias("action"))


def complaint_summary(df: DataFrame, order: str = "row_order") -> DataFrame:
    """Complaints by aspect over all negative reviews."""
    groups = complaint_groups(df, [], order)
    total = F.sum("count").over(Window.partitionBy())      # at most one row per aspect
    share = F.col("share_pct")
    urgent = F.col("aspect").isin(*URGENT_ASPECTS) & _mentions("issue", URGENT_ISSUE_TERMS)
    return (groups.withColumn("share_pct", share_pct(F.col("count"), total))
            .withColumn("priority", F.when((share >= 20) | urgent, "HIGH")
                        .when(share >= 10, "MEDIUM").otherwise("LOW"))
            .select("aspect", "count", "share_pct", "issue", "priority", "action",
                    "high_priority"))


def product_complaints(df: DataFrame, order: str = "row_order") -> DataFrame:
    """Complaints by product and aspect."""
    groups = complaint_groups(df, ["product"], order)
    total = F.sum("count").over(Window.partitionBy("product"))
    share, count = F.col("share_pct"), F.col("count")
    critical = _mentions("issue", CRITICAL_ISSUE_TERMS) & (count >= 3)
    return (groups.withColumn("share_pct", share_pct(count, total))
            .withColumn("priority", F.when((share >= 25) | critical, "HIGH")
                        .when((share >= 12) | (count >= 2), "MEDIUM").otherwise("LOW"))
            .select("product", "aspect", "count", "share_pct", "issue", "priority", "action",
                    "high_priority"))


def top_issue_per_aspect(df: DataFrame, order: str = "row_order") -> DataFrame:
    return complaint_groups(df, [], order).select("aspect", F.col("issue").alias("top_issue"))


def high_priority_count(df: DataFrame) -> DataFrame:
    """Negative reviews whose priority is HIGH."""
    return negative_intelligence(df).agg(
        F.count_if(F.col("priority") == "HIGH").alias("high_priority_count"))


def rank_concerns(summary: DataFrame, keys: list[str] | None = None, k: int = 4) -> DataFrame:
    """The ``k`` largest aspects of a complaint summary (four cards, three next steps)."""
    return top_per_group(summary, keys or [], [F.col("count").desc()], k, "aspect")


def aspect_share(complaints: DataFrame, k: int = 8) -> DataFrame:
    """Per product: share of its ``k`` largest aspects, the dominant one flagged."""
    top = rank_concerns(complaints, ["product"], k)
    return top.select("product", "aspect", F.round("share_pct", 1).alias("share_pct"), "rank",
                      (F.col("rank") == 1).alias("is_dominant"))


def aspect_evidence(df: DataFrame, per_aspect: int = 6, order: str = "row_order") -> DataFrame:
    """First negative reviews of every product and aspect, safe for display."""
    tagged = negative_intelligence(df).withColumnRenamed("primary_aspect", "aspect")
    first = top_per_group(tagged, ["product", "aspect"], [], per_aspect, order)
    return first.withColumns({
        "stars": labels.star_label(F.col("rating")),
        "safe_text": tx.html_escape(tx.trim_spaces(F.col("text"))),
        "safe_title": tx.html_escape(tx.trim_spaces(F.col("title")))})


# ---------------------------------------------------------------- products
def product_catalog(df: DataFrame) -> DataFrame:
    """Products by volume with a display label."""
    return (df.filter(F.col("product").isNotNull()).groupBy("product")
            .agg(F.count(F.lit(1)).alias("review_count"))
            .withColumn("label", F.concat(F.col("product"), F.lit(" ("),
                                          F.format_number("review_count", 0), F.lit(" reviews)")))
            .orderBy(F.col("review_count").desc(), F.col("product").asc()))


def product_counts(df: DataFrame) -> DataFrame:
    """Reviews per product; a missing or empty product shows as General."""
    name = F.coalesce(F.nullif(F.col("product"), F.lit("")), F.lit("General"))
    return df.groupBy(name.alias("product")).agg(F.count(F.lit(1)).alias("review_count"))


def product_kpis(df: DataFrame) -> DataFrame:
    """Per product: volume, shares, mean rating, verified share, first and last date."""
    counts = df.groupBy("product").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("sentiment") == c).alias(f"{c}_count") for c in LABELS],
        F.avg("rating").alias("avg_rating"),
        F.count_if("verified_purchase").alias("_verified"),
        F.min("date_dt").alias("first_date"), F.max("date_dt").alias("last_date"))
    total = F.col("total")
    return counts.select(
        "product", "total", *[f"{c}_count" for c in LABELS],
        *[share_pct(F.col(f"{c}_count"), total).alias(f"{c}_pct") for c in LABELS],
        "avg_rating", share_pct(F.col("_verified"), total).alias("verified_pct"),
        "first_date", "last_date")


def date_coverage(kpis: DataFrame) -> DataFrame:
    """Display range of each product's dates."""
    def month(c: str) -> Column:
        return F.date_format(c, "MMM yyyy")
    return kpis.select("product", F.coalesce(
        F.concat(month("first_date"), F.lit(" – "), month("last_date")),
        F.lit("All Available")).alias("date_coverage"))


def product_compare(df: DataFrame, products: list[str]) -> DataFrame:
    """Shares of up to four chosen products, in the chosen order."""
    if len(products) > 4:
        raise ValueError("compare at most four products")
    position = F.array_position(F.array(*[F.lit(p) for p in products]), F.col("product"))
    shares = df.filter(F.col("product").isin(*products)).groupBy("product").agg(
        F.count(F.lit(1)).alias("total"), *labels.class_counts(F.col("sentiment")))
    return shares.select(
        "product", *[share_pct(F.col(c), F.col("total")).alias(c) for c in LABELS], "total",
        position.cast("int").alias("position")).orderBy("position")


def purchase_confidence(kpis: DataFrame) -> DataFrame:
    """Confidence tier and normalised four-band split from each product's positive share."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("positive_pct")))
    tier = None
    for below, name in TIERS:
        tier = (F if tier is None else tier).when(F.col("score") < below, name)
    s = F.col("score")
    bands = {
        "avoid": 100.0 - s,
        "mixed": F.greatest(F.lit(0.0), F.least(s, F.lit(20.0))),
        "buy": F.greatest(F.lit(0.0), F.least(s - 20.0, F.lit(45.0))),
        "toptier": F.greatest(F.lit(0.0), s - 65.0),
    }
    raw = (kpis.select("product", score.alias("score"))
           .withColumns({"tier": tier.otherwise(TOP_TIER),
                         **{b: F.round(v, 1) for b, v in bands.items()}})
           .withColumn("_all", sum((F.col(b) for b in bands), F.lit(0.0))))
    return raw.select("product", "score", "tier", *[
        F.when(F.col("_all") > 0, F.round(F.col(b) / F.col("_all") * 100, 1))
         .otherwise(F.col(b)).alias(b) for b in bands])


def product_narrative(kpis: DataFrame, complaints: DataFrame) -> DataFrame:
    """One plain-text paragraph per product."""
    ranked = rank_concerns(complaints, ["product"], 2)

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    top = ranked.groupBy("product").agg(
        at(1, "aspect").alias("a1"), at(1, "share_pct").alias("s1"), at(1, "issue").alias("i1"),
        at(2, "aspect").alias("a2"), at(2, "share_pct").alias("s2"))

    def pct(c: str) -> Column:
        return F.format_string("%.1f%%", F.round(c, 1))

    def number(c: str) -> Column:
        return F.format_number(c, 0)

    values = {"a1": F.col("a1"), "s1": pct("s1"), "i1": F.col("i1"), "a2": F.col("a2"), "s2": pct("s2"),
              "total": number("total"), "negative_count": number("negative_count"), "phrase": F.col("phrase"),
              **{c: pct(f"{c}_pct") for c in LABELS}}

    def filled(name: str) -> Column:
        parts = re.split(r"\{(\w+)\}", NARRATIVES[name])
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    phrase = F.when(F.col("s2") >= 15, filled("two_concerns")).otherwise(filled("one_concern"))
    return (kpis.join(top, "product", "left").withColumn("phrase", phrase)
            .select("product", F.when(F.col("negative_count") == 0, filled("praise"))
                    .when(F.col("positive_pct") >= 70, filled("mostly_good"))
                    .when(F.col("negative_pct") >= 30, filled("friction"))
                    .otherwise(filled("balanced")).alias("narrative")))


def product_audit(df: DataFrame) -> DataFrame:
    """The six export columns of a product audit."""
    return df.select("product", "rating", "sentiment", "verified_purchase", "title", "text")
