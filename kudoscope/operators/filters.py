"""Filters, feeds, pages and samples over review tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kudoscope.functions import labels, text as tx
from kudoscope.functions.rules import with_intelligence
from kudoscope.operators.ranking import draw_hash, top_per_group
from kudoscope.session import materialise

ALL = "All"
# Keys at which a turn of ``deep_page`` cuts a range.
CUTS = 64
# Rows before a page up to which one top-n passes over them; both ways give the same page.
DEEP = 10_000


def search_predicate(query: str, literal: bool = False) -> Column:
    """Regular expression (or literal) found in lower-cased text or title."""
    pattern = query.strip().lower()
    if literal:
        return (F.coalesce(F.contains(F.lower("text"), F.lit(pattern)), F.lit(False))
                | F.coalesce(F.contains(F.lower("title"), F.lit(pattern)), F.lit(False)))
    return (F.coalesce(F.lower("text").rlike(pattern), F.lit(False))
            | F.coalesce(F.lower("title").rlike(pattern), F.lit(False)))


def filter_reviews(df: DataFrame, products: list[str] | None = None,
                   ratings: list | None = None, sentiments: list[str] | None = None,
                   verified_only: bool = False, search: str = "",
                   literal: bool = False) -> DataFrame:
    """Interactive filters. An empty list and ``All`` mean no filter."""
    if products and ALL not in products:
        df = df.filter(F.col("product").isin(*products))
    if ratings and ALL not in ratings:
        stars = [float(r) for r in ratings if re.fullmatch(r"\d+\.?\d*|\.\d+", str(r))]
        if stars:
            df = df.filter(F.col("rating").isin(*stars))
    if sentiments and ALL not in sentiments:
        df = df.filter(F.col("sentiment").isin(*[s.lower() for s in sentiments]))
    if verified_only:
        df = df.filter(F.col("verified_purchase"))
    if search and search.strip():
        df = df.filter(search_predicate(search, literal))
    return df


# sort name -> leading sort keys; nulls go last, review_id breaks ties
FEED_ORDERS = {
    "Most Recent": lambda: [F.col("date_dt").desc_nulls_last()],
    "Highest Rating": lambda: [F.col("rating").desc_nulls_last()],
    "Lowest Rating": lambda: [F.col("rating").asc_nulls_last()],
    "Most Helpful": lambda: [F.col("helpful_votes").desc_nulls_last()],
}
MISMATCH_ONLY = "Mismatch Cases Only"


def feed_rows(df: DataFrame, sort_by: str = "Most Recent", aspect: str | None = None) -> DataFrame:
    """All rows a feed would show, unordered: coerced, flagged and filtered."""
    df = df.withColumns({
        "helpful_votes": F.coalesce(F.col("helpful_votes").try_cast("int"), F.lit(0)),
        "rating": F.coalesce(F.col("rating").try_cast("double"), F.lit(5.0)),
    })
    df = df.withColumn("is_mismatch", labels.is_mismatch(F.col("rating"), F.col("sentiment")))
    if sort_by == MISMATCH_ONLY:
        df = df.filter("is_mismatch")
    elif sort_by not in FEED_ORDERS:
        raise ValueError(f"unknown feed order {sort_by!r}")
    if aspect:
        df = aspect_filter(df, aspect)
    return df


def aspect_filter(df: DataFrame, aspect: str) -> DataFrame:
    """Rows whose detected aspects hold ``aspect``."""
    keep = df.columns
    return (with_intelligence(df).filter(F.array_contains("all_aspects", aspect)).select(*keep))


def feed_page(df: DataFrame, sort_by: str = "Most Recent", aspect: str | None = None,
              page_size: int = 10, order: str = "review_id") -> DataFrame:
    """One feed page with display fields. The rules run on the page only."""
    keys = FEED_ORDERS[sort_by]() if sort_by in FEED_ORDERS else []
    page = feed_rows(df, sort_by, aspect).orderBy(*keys, F.col(order).asc()).limit(page_size)
    return with_intelligence(page).withColumns({
        "stars": labels.star_label(F.col("rating")),
        "snippet": tx.snippet(F.col("text")),
        "day": F.substring(F.coalesce("date", F.lit("")), 1, 10),
    })


def feed_total(df: DataFrame, sort_by: str = "Most Recent", aspect: str | None = None,
               page_size: int = 10) -> DataFrame:
    """``(shown, total_rows)`` of a feed."""
    total = feed_rows(df, sort_by, aspect).agg(F.count(F.lit(1)).alias("total_rows"))
    return total.select(F.least(F.col("total_rows"), F.lit(page_size)).alias("shown"), "total_rows")


def paginate(df: DataFrame, skip: int = 0, limit: int = 100, order: str = "review_id") -> DataFrame:
    """Offset / limit in a stable order: one distributed top-n, deep pages by ``deep_page``."""
    if skip > DEEP:
        return deep_page(df, skip, limit, order)
    return df.orderBy(order).offset(skip).limit(limit)


def page_after(df: DataFrame, after: str | int | None, limit: int = 100, order: str = "review_id") -> DataFrame:
    """The page behind the key ``after`` (the first page for None): a pushed-down range and a top-n.

    ``order`` must be unique and not null; the caller hands on the last key of a page.
    """
    rows = df if after is None else df.filter(F.col(order) > F.lit(after))
    return rows.orderBy(order).limit(limit)


def deep_page(df: DataFrame, skip: int = 0, limit: int = 100, order: str = "review_id",
              enough: int = 10_000) -> DataFrame:
    """The rows of ``paginate`` for any depth, without ordering what lies before the page.

    Each turn draws ``CUTS`` keys of the range the page lies in, counts the rows between these
    cuts exactly, and goes on with the parts that the page touches, until they hold at most
    ``enough`` rows beside the page. Which keys are drawn changes the number of turns only. A turn
    hands the driver ``CUTS`` keys and as many counts, the last one at most ``enough`` rows and the
    page, if keys are unique. Parts that hold less than half of the rows are written, so that the
    turns after the first do not pass over ``df`` again; rows of equal keys stay together, as in ``paginate``. Null keys come
    first; a page beyond the last row is empty.
    """
    key, rows, before = F.col(order), df, 0
    while True:
        drawn = rows.filter(key.isNotNull()).select(order).orderBy(F.rand(0)).limit(CUTS).collect()
        cuts = sorted({r[0] for r in drawn})
        part = F.lit(-1)  # null keys and those before the first cut
        for i in reversed(range(len(cuts))):
            test = key >= F.lit(cuts[i])
            part = F.when(test, i) if i == len(cuts) - 1 else part.when(test, i)
        if cuts:
            part = part.otherwise(-1)
        counts = sorted(rows.groupBy(part.alias("part")).count().collect())
        touched, end = [], before
        for i, n in counts:
            start, end = end, end + n
            if end > skip and start < skip + limit:
                touched.append((i, start, n))
        if not touched:
            return df.limit(0)
        (low, before, _), high = touched[0], touched[-1][0]
        if low >= 0:
            rows = rows.filter(key >= F.lit(cuts[low]))
        if high + 1 < len(cuts):
            ahead = key < F.lit(cuts[high + 1])
            rows = rows.filter(ahead if low >= 0 else ahead | key.isNull())
        held = sum(n for *_, n in touched)
        if held <= limit + enough or len(touched) == len(counts):
            return rows.orderBy(order).offset(skip - before).limit(limit)
        if 2 * held < sum(n for _, n in counts):
            rows = materialise(rows, "page-range")


def sample_cap(df: DataFrame, unique: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows, chosen at random but repeatably."""
    draw = draw_hash(F.col(unique), seed)
    return df.orderBy(draw, F.col(unique)).limit(cap)


def mismatch_samples(df: DataFrame, per_kind: int = 4, order: str = "review_id") -> DataFrame:
    """First rows of each mismatch kind with their intelligence."""
    rating, sentiment = F.col("rating"), F.col("sentiment")
    kinds = df.withColumn("kind", F.when(labels.over_rated(rating, sentiment), "over_rated")
                          .when(labels.under_rated(rating, sentiment), "under_rated"))
    first = top_per_group(kinds.filter(F.col("kind").isNotNull()), ["kind"], [], per_kind, order)
    return with_intelligence(first).withColumn("excerpt", tx.snippet(F.col("text"), always=True))


def recent_predictions(log: DataFrame, count: int = 8) -> DataFrame:
    """Newest logged predictions with a short snippet."""
    return (log.orderBy(F.col("timestamp").desc(), F.col("review_id").asc()).limit(count)
            .withColumn("snippet", tx.snippet(F.col("text"), 70, "...")))
