"""Pages, their links and what is still to be collected."""

import time
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from lodestack.sources import pages

FIELDS = ("title", "heading", "page_lang", "n_links", "text_length")


def test_urls_resolve_as_the_standard_says(spark):
    base = "http://a/b/c/d;p?q"
    hrefs = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "mailto:me@x.org"]
    rows = [(h, b) for h in hrefs for b in (base, "https://x.org", "https://x.org/", "https://x.org/p/q?r=1#s")]
    got = spark.createDataFrame(rows, "href string, base string").select("href", "base", pages.resolved(F.col("href"), F.col("base")).alias("u")).collect()
    assert not [(r, want) for r in got if r.u != (want := urldefrag(urljoin(r.base, r.href)).url)]
    # with a host of its own the standard removes dots too, which the library leaves
    own = spark.createDataFrame([("https://x.org/a/../b", "http://h/"), ("//x.org/a/./b?c", "http://h/")], "href string, base string")
    assert [r.u for r in own.select(pages.resolved(F.col("href"), F.col("base")).alias("u")).collect()] == ["https://x.org/b", "http://x.org/a/b?c"]


def test_references(spark):
    cases = {"a &amp; b": "a & b", "&lt;&#65;&#x1F600;&eacute;": "<A\U0001f600é", "&#0;&#xD800;&#9999999;": "�" * 3, "&nosuch; & &amp": "&nosuch; & &amp", "&amp;lt;": "&lt;", "": "", "plain": "plain"}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", pages.decoded(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_pages_of_every_kind(spark):
    html = {
        1: "<html class=x lang='DE'><TITLE>T</TITLE><h1> A <b>b</b>&amp;c </h1><!-- <a href=no>no</a> --><a class=k href = '/x y'>one</a><a name=z>none</a><A HREF=two>\n two<b>2</b></A>",
        2: None,
        3: "",
        4: "<script>var a='<!--';</script>seen<!-- open <a href=q>q</a>",
        5: "a < b <a data-href=/no>x</a><style>p</style><title></title><abbr href=/no>y</abbr>",
        6: "<script>no end <a href=/q>q</a>",
    }
    df = spark.createDataFrame([(k, "https://h.org/d/e", v, "mine") for k, v in html.items()], "page_id int, url string, html string, title string")
    got = {r.page_id: (r.title, r.heading, r.page_lang, r.n_links, r.text_length) for r in pages.extract(df, fields=FIELDS).collect()}
    assert got == {
        1: ("T", "A b&c", "de", 2, len("Ab&c") + len("one") + len("none") + len("two2")), 2: (None, None, None, 0, 0), 3: (None, None, None, 0, 0),
        4: (None, None, None, 0, 4), 5: (None, None, None, 0, len("a < b") + 2), 6: (None, None, None, 0, 0),
    }
    links = pages.links(df).orderBy("page_id", "position").select("page_id", "title", "position", "href", "target", "anchor").collect()
    assert [tuple(r) for r in links] == [(1, "mine", 0, "/x y", "https://h.org/x y", "one"), (1, "mine", 1, "two", "https://h.org/d/two", "two")]
    assert pages.links(df.limit(0)).count() == 0 and pages.extract(df.limit(0), fields=FIELDS).count() == 0


def test_frontier_leaves_out_what_is_there(spark):
    a = '<a href="/b">x</a><a href="b#part">x</a><a href="/new">y</a><a href="/new#z">y</a><a href="mailto:a@b">z</a>'
    rows = [(1, "https://h.org/a", a), (2, "https://h.org/b#top", '<a href="new">n</a><a href="/a">a</a><a href="/c?x=1&amp;y=2">c</a>'), (3, None, '<a href="/lost">l</a>'), (4, "https://h.org/a", None)]
    got = pages.frontier(spark.createDataFrame(rows, "page_id int, url string, html string"), "page_id").collect()
    assert sorted(map(tuple, got)) == [("https://h.org/c?x=1&y=2", 1, 2), ("https://h.org/new", 2, 1)]


def test_hostile_pages_take_linear_time(spark):
    n = 200_000
    bad = ["<!--" * n, "<script" * n, "<title>" * n, "<a " * n, "<" * n, " " * n + "x", "<a href=" + "x" * n, "<a href=\"" * n, "<a " + " href=x" * n, "<a " + " href='" * n + ">", "&" * n, "<h1>" * n, "<html " + "a " * n]
    df = spark.createDataFrame([(i, "https://h.org/", b) for i, b in enumerate(bad)], "page_id int, url string, html string")
    began = time.time()
    assert pages.extract(df, fields=FIELDS).count() == len(bad) and pages.extract(df, fields=FIELDS).agg(F.sum("text_length"), F.sum(F.length("heading"))).collect()
    assert pages.links(df).agg(F.count("target")).collect()
    assert time.time() - began < 60
