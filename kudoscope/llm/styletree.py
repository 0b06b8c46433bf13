"""Main text of web pages with a site style tree.

All pages of a host are merged into one tree: a node is a path of tags with their
class, id and role. A node whose pages hang the same content or the same sequence of
children below it is boilerplate; one that differs from page to page is content. Both
are entropies over the pages of the node, to the base of their number, so a node that
only one page has is never judged by it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kudoscope.llm import common
from kudoscope.session import materialise

MIN_IMPORTANCE = 0.2
MAX_LINKED = 0.5   # share of a block's letters inside links, outside an article
MIN_PAGES = 3      # pages a node needs before its entropies count

# Elements by their part in a page.
NOT_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video select button "
                     "textarea datalist head title".split())
FURNITURE = frozenset("nav aside form footer menu dialog".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head".split())
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
MARKED = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar "
                   "side menu nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies "
                   "consent notice notices gdpr popup modal newsletter subscribe subscription signup social share "
                   "sharing related recommended comment comments disqus respond reply replies pager pagination "
                   "login search toolbar widget skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_NAME = re.compile(r"[a-z]+")


class _Reader(HTMLParser):
    """Turns a page into blocks ``node, prose, text, kept, main, linked`` and node styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # an open element: tag, path key, furniture, inside an article, children so far
        self.stack: list[list] = [["", 0, False, False, []]]
        self.blocks: list[tuple] = []
        self.styles: set[tuple[int, int]] = set()
        self.parts: list[str] = []
        self.links = self.linked = self.mute = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = next(e for e in reversed(self.stack) if e[0] not in INLINE)
            self.blocks.append((top[1], top[0] in PROSE, text, not top[2], top[3], self.linked))
        self.parts, self.linked = [], 0

    @staticmethod
    def _marked(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
        if tag in FURNITURE or tag == "header" and not in_article:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        if (attrs.get("role") or "").strip().lower() in ROLES:
            return True
        if tag in ("html", "body", *ARTICLE):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        return any(n in MARKED for n in _NAME.findall(names))

    def _end_head(self) -> None:
        """Close a head left open; what may not stand in it begins the body."""
        if self.stack[-1][0] == "head":
            self._close(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in EMPTY:
            if tag not in INLINE:
                self._flush()
            self.parts.append(" " if tag == "br" else "")
            return
        if tag not in INLINE:
            self._flush()
            self._imply(tag)
        given = dict(attrs)
        above = self.stack[-1]
        style = f"{tag}.{given.get('class') or ''}#{given.get('id') or ''}@{given.get('role') or ''}"
        key = xxhash.xxh64_intdigest(style, above[1]) >> 1
        above[4].append(style)
        banned = above[2] or self._marked(tag, given, above[3])
        self.stack.append([tag, key, banned, above[3] or tag in ARTICLE, []])
        self.mute += tag in NOT_TEXT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag in ("svg", "math", "path", "iframe"):
            self.handle_endtag(tag)

    def _imply(self, tag: str) -> None:
        """Close a paragraph before a block, and an item before its next sibling."""
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at][0]
            if open_tag == "p" or open_tag in (_CLOSED_BY.get(tag) or ()):
                self._close(at)
                return
            if open_tag not in INLINE:
                return

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            tag, key, _, _, children = self.stack.pop()
            self.mute -= tag in NOT_TEXT
            self.links -= tag == "a"
            if tag not in INLINE and children:
                self.styles.add((key, xxhash.xxh64_intdigest("|".join(children)) >> 1))

    def handle_endtag(self, tag: str) -> None:
        if tag in EMPTY:
            return
        if tag not in INLINE:
            self._flush()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.mute:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def read(self, html: str) -> tuple[list[tuple], list[tuple[int, int]]]:
        self.feed(html)
        self.close()
        self._flush()
        self._close(1)
        return self.blocks, sorted(self.styles)


_BLOCK = "struct<node:long,prose:boolean,text:string,kept:boolean,main:boolean,linked:int>"
_PARSED = f"struct<blocks:array<{_BLOCK}>,styles:array<struct<node:long,style:long>>>"


def parse(html: Column) -> Column:
    """A page's blocks in order and the child sequences of its elements; none for null."""
    @F.pandas_udf(_PARSED)
    def read(pages: pd.Series) -> pd.DataFrame:
        done = [_Reader().read(page) if page else ([], []) for page in pages]
        block = ("node", "prose", "text", "kept", "main", "linked")
        return pd.DataFrame({"blocks": [[dict(zip(block, b)) for b in blocks] for blocks, _ in done],
                             "styles": [[{"node": n, "style": s} for n, s in styles] for _, styles in done]})

    return read(html)


def _entropies(rows: DataFrame, what: str) -> DataFrame:
    """Per node of MIN_PAGES pages or more: both views of the values ``what`` that pages hang below it.

    A value on n of a node's m pages has entropy log_m(n); the mean over the distinct
    values says how much of the content is shared. The entropy of the values' own
    distribution says how much the pages differ. Both are made from sums over the
    values, so a host with a third of all pages is added up before it is shuffled, and
    only one row per node meets the number of its pages.
    """
    pages = (rows.groupBy("host", "node").agg(F.countDistinct("page").alias("pages"))
             .filter(F.col("pages") >= MIN_PAGES))
    counts = rows.groupBy("host", "node", what).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.groupBy("host", "node").agg(
        F.avg(F.log("n")).alias("mean_log"), F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    base = F.log(F.col("pages").cast("double"))
    return sums.join(pages, ["host", "node"]).select(
        "host", "node", (F.col("mean_log") / base).alias("shared"),
        ((F.col("total") - F.col("n_log_n") / base) / F.col("pages")).alias("varied"))


def importances(parsed: DataFrame) -> DataFrame:
    """The merged tree: ``host, node, importance``, 0 to 1, for nodes of MIN_PAGES pages or more.

    A node that holds text has content importance 1 minus the mean entropy of its
    texts; a node that holds elements has the entropy of their sequences. A node with
    both counts as important if either is.
    """
    page = F.xxhash64("page_id", "url", "html_key").alias("page")
    texts = (parsed.select("host", page, F.explode("parsed.blocks").alias("b"))
             .select("host", "page", F.col("b.node").alias("node"), F.xxhash64("b.text").alias("value")).distinct())
    styles = (parsed.select("host", page, F.explode("parsed.styles").alias("s"))
              .select("host", "page", F.col("s.node").alias("node"), F.col("s.style").alias("value")).distinct())
    content = _entropies(texts, "value").select("host", "node", (1 - F.col("shared")).alias("importance"))
    looks = _entropies(styles, "value").select("host", "node", F.col("varied").alias("importance"))
    return (content.unionByName(looks)
            .groupBy("host", "node").agg(F.max("importance").alias("importance")))


def main_text(pages: DataFrame, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """``page_id, url, text`` per row of ``pages`` (page_id, url, html).

    Scripts, forms, menus and the like go by their element, role or class, and so does
    all they hold. If a page has an article, the blocks outside it go. What is left and
    is not a heading or a paragraph of an article has to be important: a block below a
    node whose texts repeat from page to page of the host goes, and outside an article
    also one that is mostly links. Nothing is dropped for its length.

    A null or empty page gives an empty text; so does one without text. A null or odd
    url is a host of its own kind. Broken markup is read as browsers do, as far as the
    order of text goes: unknown and unclosed elements end with the one around them.
    Rows that repeat give as many rows; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    read = pages.select("page_id", "url", F.xxhash64(F.coalesce("html", F.lit(""))).alias("html_key"),
                        host.alias("host"), parse(F.col("html")).alias("parsed"))
    read = materialise(read, "style-pages")
    low = importances(read).filter(F.col("importance") < min_importance).select("host", "node")
    low = materialise(low, "style-low")

    has_main = F.exists("parsed.blocks", lambda b: b["main"] & b["kept"])
    open_blocks = F.filter("parsed.blocks", lambda b: b["kept"] & F.when(
        F.col("has_main"), b["main"]).otherwise(b["linked"] <= MAX_LINKED * F.length(b["text"])))
    rows = read.withColumn("has_main", has_main).withColumn("blocks", open_blocks)
    in_doubt = F.array_distinct(F.transform(
        F.filter("blocks", lambda b: ~(b["main"] & b["prose"])), lambda b: b["node"]))
    doubted = rows.select("page_id", "url", "html_key", "host", F.explode(in_doubt).alias("node")).distinct()
    gone = (doubted.join(low, ["host", "node"])
            .groupBy(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("html_key").alias("_key"))
            .agg(F.collect_set("node").alias("gone")))
    gone = materialise(gone, "style-gone")
    joined = rows.join(gone, rows["page_id"].eqNullSafe(F.col("_id")) & rows["url"].eqNullSafe(F.col("_url"))
                       & (rows["html_key"] == F.col("_key")), "left")
    left = F.filter("blocks", lambda b: F.col("gone").isNull() | (b["main"] & b["prose"])
                    | ~F.array_contains("gone", b["node"]))
    return joined.select("page_id", "url", F.array_join(F.transform(left, lambda b: b["text"]), "\n\n").alias("text"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = main_text(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
