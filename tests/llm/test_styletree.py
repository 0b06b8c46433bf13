"""Main text: planted pages, broken markup, and the merged tree of a host."""

import html as entities
import re

import pytest
from llm_cases import rows

from kudoscope.llm import styletree

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    data = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = styletree.main_text(spark.createDataFrame(data, PAGES)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in styletree.main_text(frame).collect()}
    for r in frame.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


FULL = """<!doctype html><title>t</title><header class=top><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice">We use cookies</div>
<main><article><h2>Head &amp; line</h2><p>First   <b>bold</b>
 text&nbsp;here&#33;<p>Second <a href=x>with a link</a>, 1 &lt; 2<script>var a = "<p>no</p>"</script>
<aside>Related: more</aside><div class="ad-box">Buy</div><form><p>Mail <input></form>
<ul><li>one<li>two</ul><pre>a
  b</pre><!-- c --><section class="comments"><p>I disagree</p></section>
<footer>By me</footer></article></main>
<div class="sidebar"><p>Popular</p></div><footer>&copy; all</footer>"""


def test_an_article_among_furniture(spark):
    want = "Head & line\n\nFirst bold text here!\n\nSecond with a link, 1 < 2\n\none\n\ntwo\n\na b"
    assert texts(spark, [("http://a.org/1", FULL)]) == [want]


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<article><p>a<b>b<p>c", "ab\n\nc"),
    ("<article><p>x</article></div></p>", "x"), ("<<p>>a", "<\n\n>a"), ("<div><p>a</div>b", "a\n\nb"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><p>" + "word " * 50_000, ("word " * 50_000).strip()),
    ("<article><p>&zzz; &amp &#x41;</p>", "&zzz; & A"), ("<style>p{}</style><script>x</script>", ""),
    ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
    ("<html><head><title>t</title><body><p>text", "text"), ("<head><meta charset=x><title>t</title><p>a<p>b", "a\n\nb"),
    ("<head><script>x</script>text", "text"), ("<head><title>t</title><style>p{}</style> <img src=x><b>a</b>", "a"),
    ("<head><title>t</title>\n</head><body><p>a", "a"),
])
def test_odd_pages(spark, html, want):
    assert texts(spark, [("http://a.org/1", html)]) == [want]


def test_odd_rows(spark):
    data = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "no url", "<p>b</p>"), (2, "http://h/", None)]
    frame = spark.createDataFrame([d + ("x",) for d in data], PAGES + ", text string")
    assert rows(styletree.main_text(frame)) == sorted(
        [(1, None, "a"), (1, None, "a"), (None, "no url", "b"), (2, "http://h/", "")], key=repr)
    assert styletree.main_text(frame.filter("page_id > 9")).collect() == []


def site(n, article=False):
    """Pages of a host whose template repeats without telling tags or classes."""
    tag = "article" if article else "div"
    return [("http://Site.org/%d" % i, f"<div class=x1>Our site, since 1999</div><{tag} class=x2><p>Story {i} on {i * i}"
             f"</p><p>same line</p><div class=x4>Press the bell</div></{tag}><div class=x3><p>All rights kept</p></div>")
            for i in range(n)]


def test_repeated_branches_of_a_host_go(spark):
    got = texts(spark, site(8))
    assert got == [f"Story {i} on {i * i}\n\nsame line" for i in range(8)]
    # in an article too, but its paragraphs stay, repeated or not
    assert texts(spark, site(8, article=True)) == got
    # one page tells nothing about its host
    assert texts(spark, site(1)) == ["Our site, since 1999\n\nStory 0 on 0\n\nsame line\n\nPress the bell\n\nAll rights kept"]


def test_importances_by_hand(spark):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site(8))], PAGES)
    parsed = frame.select("page_id", "url", styletree.F.xxhash64("html").alias("html_key"),
                          styletree.F.lit("h").alias("host"), styletree.parse(frame["html"]).alias("parsed"))
    tree = {r.node: r.importance for r in styletree.importances(parsed).collect()}
    first = parsed.orderBy("page_id").first().parsed.blocks
    by_text = {b.text: round(tree[b.node], 6) for b in first}
    # eight texts of their own and one on all eight pages: mean entropy (8 x 0 + 1) / 9
    assert by_text["Story 0 on 0"] == round(1 - 1 / 9, 6)
    assert by_text["All rights kept"] == by_text["Our site, since 1999"] == 0
