"""Records, links and the list of what is still to be collected, from saved HTML pages.

Everything is made of Spark's own string functions. Comments, scripts and styles count for nothing; one without an end reaches to the end of the page. A tag is
``<``, a letter or one of ``/!?``, and all up to ``>``; angle brackets inside an attribute's value are not told from a tag's own. Character references need
their semicolon; unknown names stay as they are, numbers that are no character become U+FFFD. A null page is an empty one.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: every pattern ends an open element at the end of the page, so that each is read once
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)"
TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title\s*>|\z)"
HEADING = r"(?is)<h1\b[^<>]*>(.*?)(?:</h1\s*>|\z)"
LANGUAGE = r"""(?i)<html(?:\s[^<>]*?)?\slang\s*=\s*["']?([A-Za-z0-9-]+)"""
TAG = r"<[A-Za-z/!?][^<>]*>"
LINK = r"(?i)<a\s[^<>]*+>[^<>]*+"
HREF = r"""(?i)^<a(?:\s[^<>]*?)?\shref\s*+=\s*+("[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++)"""
REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};|[^&]+|&"
#: the pattern of RFC 3986, appendix B
URL = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
SPACE = " \t\n\r\f"


def _character(code: Column) -> Column:
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """``text`` with its character references replaced."""
    names = F.from_json(F.lit(json.dumps({k: chr(v) for k, v in name2codepoint.items()})), "map<string,string>")

    def one(piece: Column) -> Column:
        return (
            F.when(piece.rlike("^&#[xX]."), _character(F.conv(piece.substr(F.lit(4), F.length(piece) - 4), 16, 10).cast("long")))
            .when(piece.rlike("^&#."), _character(piece.substr(F.lit(3), F.length(piece) - 3).cast("long")))
            .when(piece.rlike("^&."), F.coalesce(names[piece.substr(F.lit(2), F.length(piece) - 2)], piece))
            .otherwise(piece)
        )

    replaced = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), "")
    return F.when(F.contains(text, F.lit("&")), replaced).otherwise(text)


def _inner(text: Column) -> Column:
    return F.nullif(decoded(F.btrim(F.regexp_replace(text, TAG, ""), F.lit(SPACE))), F.lit(""))


def _seen(html: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(html), F.lit("")), UNSEEN, "<!>")


def _links(seen: str) -> Column:
    """The link tags that have an address, each with the text behind it."""
    return F.filter(F.regexp_extract_all(seen, F.lit(LINK), F.lit(0)), lambda link: link.rlike(HREF))


def _href(link: Column) -> Column:
    raw = F.regexp_extract(link, HREF, 1)
    bare = F.when(raw.rlike("""^["']"""), raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.btrim(decoded(bare), F.lit(SPACE))


def extract(pages: DataFrame, html: str = "html", fields: tuple[str, ...] = ("title", "n_links", "text_length")) -> DataFrame:
    """The pages' other columns, with the ``fields`` asked for: title (of the first title element: others belong to drawings), heading (the first one), page_lang (that the page
    names), n_links, and text_length in characters, each run between two tags without the white space around it. What a page lacks is null; input columns of these names are replaced."""
    runs = F.transform(F.split(F.regexp_replace("_seen", TITLE, "<!>"), TAG), lambda run: F.length(decoded(F.btrim(run, F.lit(SPACE)))))
    found = {
        "title": F.nullif(decoded(F.regexp_extract("_seen", TITLE, 1)), F.lit("")),
        "heading": _inner(F.regexp_extract("_seen", HEADING, 1)),
        "page_lang": F.nullif(F.lower(F.regexp_extract("_seen", LANGUAGE, 1)), F.lit("")),
        "n_links": F.size(_links("_seen")),
        "text_length": F.aggregate(runs, F.lit(0), lambda total, n: total + n),
    }
    kept = [F.col(f"`{c}`") for c in pages.columns if c != html and c not in fields]
    return pages.withColumn("_seen", _seen(html)).select(*kept, *[found[name].alias(name) for name in fields])


def _without_dots(path: Column) -> Column:
    def step(done: Column, segment: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.array_append(done, segment))

    segments = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(F.contains(path, F.lit("/.")), folded).otherwise(path)


def resolved(href: Column, base: Column) -> Column:
    """The absolute URL that ``href`` names on the page ``base``, by RFC 3986, without its fragment. Time grows with the square of a path's segments if it has ``.`` or ``..``."""

    def part(url: Column, group: int) -> Column:
        return F.regexp_extract(url, URL, group)

    path, folder = part(href, 5), F.regexp_extract(part(base, 5), "^(.*/)?", 0)
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.when((part(base, 3) != "") & (part(base, 5) == ""), F.lit("/")).otherwise(folder), path))
    own, host = part(href, 1) != "", part(href, 3) != ""
    query = F.when((path == "") & (part(href, 6) == "") & ~host & ~own, part(base, 6)).otherwise(part(href, 6))
    return F.concat(
        F.when(own, part(href, 1)).otherwise(part(base, 1)),
        F.when(own | host, part(href, 3)).otherwise(part(base, 3)),
        F.when(own | host, _without_dots(path)).when(path == "", part(base, 5)).otherwise(_without_dots(merged)),
        query,
    )


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row per link: the pages' other columns, its position (from 0), href as written, target (absolute, no fragment) and anchor (its text up to the next tag, or null).
    Input columns of these names are replaced."""
    named = pages.drop("position", "href", "target", "anchor").withColumn("_seen", _seen(html)).withColumns({"_links": _links("_seen"), "_base": F.coalesce(F.col(url), F.lit(""))}).drop(html, "_seen")
    each = named.select("*", F.posexplode("_links").alias("position", "_link")).withColumn("href", _href(F.col("_link")))
    found = {"target": resolved(F.col("href"), F.col("_base")), "anchor": _inner(F.regexp_extract("_link", ">([^<>]*)$", 1))}
    return each.withColumns(found).drop("_links", "_link", "_base")


def frontier(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """What a collector has still to fetch: each target over HTTP that is no page's URL (fragments aside), with the number of pages that link to it and the least ``key`` of these.

    A page counts once per target however often it links to it, so pages of equal keys count apart. Counts are gathered before the shuffle and the
    collected pages leave by an anti-join after it: a target that every page links to is one row there."""
    slim = pages.withColumn("_seen", _seen(html)).select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_base"), F.array_distinct(F.transform(_links("_seen"), _href)).alias("_hrefs"))
    targets = F.array_distinct(F.transform("_hrefs", lambda href: resolved(href, F.col("_base"))))
    found = slim.select("_key", F.explode(targets).alias("target")).where(F.col("target").rlike("^(?i)https?://."))
    counted = found.groupBy("target").agg(F.count("*").alias("n_pages"), F.min("_key").alias("first_page"))
    collected = pages.select(F.regexp_replace(F.col(url), "#.*$", "").alias("target")).where("target IS NOT NULL")
    return counted.join(collected, "target", "left_anti")
