"""Extraction from HTML by native columns: a stated set of patterns, not a parser."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T
from .urls import classify_url, netloc, raw_path

# JSON-LD types.
PAGE_TYPES = ("NewsArticle", "Article", "BlogPosting", "TechArticle", "ScholarlyArticle", "Report", "WebPage")
META_TYPES = ("NewsArticle", "Article", "BlogPosting", "TechArticle", "ScholarlyArticle")
JSONLD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
MIN_BODY = 200
HREF = re.compile(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""")


def _once(value: Column, use) -> Column:
    """use(value), value worked out once however often use names it: the array of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attr(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*'([^']*)'""", 1), F.lit("")))


def inner_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"^\s+|\s+$", ""))


def jsonld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))


def jsonld_meta(html: Column) -> Column:
    """First block, or first element of a list, of a known type, as JSON text; lists of types never match."""
    one = F.transform(jsonld_blocks(html), lambda b: F.when(F.trim(b).rlike(r"^\s*\["), F.get_json_object(b, "$[0]")).otherwise(b))
    return F.get(F.filter(one, lambda b: F.get_json_object(b, "$.@type").isin(*META_TYPES)), F.lit(0))


def og_map(html: Column) -> Column:
    """og: properties with content; the last of a name counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(attr(t, "property").alias("key"), attr(t, "content").alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"].startswith("og:") & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.substring(p["key"], 4, 10_000).alias("key"), p["value"].alias("value"))))


def canonical_url(html: Column, url: Column) -> Column:
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: attr(t, "rel") == "canonical")
    return F.coalesce(F.get(F.transform(links, lambda t: attr(t, "href")), F.lit(0)), url)


def headings(html: Column) -> Column:
    """h1, then h2, then h3, longer than 3 characters, at most 10."""
    every = F.concat(*(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>"), F.lit(1)), inner_text) for n in (1, 2, 3)))
    return F.slice(F.filter(every, lambda h: F.length(h) > 3), 1, 10)


def author(jsonld: Column) -> Column:
    a = F.get_json_object(jsonld, "$.author")
    return F.when(a.startswith("{"), F.get_json_object(jsonld, "$.author.name")).when(a.startswith("["), F.coalesce(F.get_json_object(jsonld, "$.author[0].name"), F.get_json_object(jsonld, "$.author[0]"))).otherwise(a)


def html_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?is)<html[^>]*\slang\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def content_type(url: Column, jsonld_type: Column) -> Column:
    path = F.lower(raw_path(url))
    return (
        F.when(path.rlike("/wiki/|^/wiki"), "wiki").when(jsonld_type.isin("NewsArticle", "ReportageNewsArticle"), "news")
        .when(jsonld_type.isin("BlogPosting", "TechArticle"), "blog").when(path.rlike("/news/|/article/|noticia|actualite"), "news")
        .when(path.rlike("/blog/|/post/|/posts/"), "blog").otherwise("article")
    )


#: Steps that turn a page into its body text, in order; both engines read these patterns alike.
BODY_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(nav|header|footer|aside)[^>]*>.*?</(nav|header|footer|aside)>", ""), (r'(?is)<div class="ad">.*?</div>', ""),
    (r"(?i)</?(p|br|h[1-6]|li|div)[^>]*>", "\n"), (r"(?s)<[^>]*>", ""),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;|&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r]*\n[ \t\r\n]*", "\n"), (r"^[ \t\r\n]+", ""), (r"[ \t\r\n]+$", ""),
)


def body_text(html: Column) -> Column:
    """Text of the article element, or of the page without one; null for under MIN_BODY characters."""
    out = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article[^>]*>(.*)</article>", 1), F.lit("")), html)
    for pattern, by in BODY_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return _once(out, lambda b: F.when(F.length(b) >= MIN_BODY, b))


def classify_page(html: Column, url: Column) -> Column:
    """struct(page_type, reason): a page can be promoted by its metadata, never demoted."""
    kind = lambda b: F.coalesce(F.get_json_object(b, "$.@type[0]"), F.get_json_object(b, "$.@type"))
    types = F.filter(F.transform(F.filter(jsonld_blocks(html), lambda b: ~F.trim(b).rlike(r"^\s*\[")), kind), lambda t: t.isin(*PAGE_TYPES))
    first = F.get(types, F.lit(0))
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0)), lambda t: attr(t, "property") == "og:type")
    og = F.lower(F.get(F.transform(tags, lambda t: attr(t, "content")), F.lit(0)))
    out = lambda why: F.struct(F.lit("article").alias("page_type"), why.alias("reason"))
    return F.when(first.isNotNull(), out(F.concat(F.lit("schema_org:"), first))).when(F.contains(og, F.lit("article")), out(F.lit("og_type_article"))).otherwise(classify_url(url))


def extract(html: Column, url: Column, as_of: Column) -> Column:
    """Struct of an article, metadata merged in the order body, JSON-LD, OpenGraph (summary: body, OpenGraph, JSON-LD).

    Body, JSON-LD, OpenGraph and headings are each found once; all else follows from them.
    """
    full = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))

    def merge(r):
        ld, og, body = r["ld"], r["og"], r["body"]
        get = lambda k: F.get_json_object(ld, f"$.{k}")
        lang = F.coalesce(F.lower(F.substring(full(get("inLanguage"), r["lang"]), 1, 2)), T.detect_language(body))
        return F.struct(
            F.nullif(r["canonical"], url).alias("canonical_url"), full(r["title"], get("headline"), og["title"]).alias("title"), full(author(ld), og["author"]).alias("author"),
            full(get("datePublished"), get("dateModified")).alias("publish_date"), lang.alias("language"), full(og["description"], get("description")).alias("summary"),
            body.alias("main_text"), r["headings"].alias("headings"), netloc(url).alias("source_domain"), content_type(url, F.get_json_object(ld, "$.@type")).alias("content_type"),
        )

    def score(a):
        q = T.quality(*(a[k] for k in ("main_text", "title", "author", "publish_date", "headings", "language")), as_of)
        names = "canonical_url title author publish_date language summary main_text headings source_domain content_type".split()
        return _once(q, lambda v: F.struct(*(a[k].alias(k) for k in names), v["score"].alias("quality_score"), v["reasons"].alias("quality_reasons")))

    found = F.struct(jsonld_meta(html).alias("ld"), og_map(html).alias("og"), body_text(html).alias("body"), headings(html).alias("headings"), html_lang(html).alias("lang"), title(html).alias("title"), canonical_url(html, url).alias("canonical"))
    return _once(_once(found, merge), score)


@F.pandas_udf(ArrayType(StringType()))
def resolved_links(html: pd.Series, url: pd.Series) -> pd.Series:
    """The older engine's links of a page to its own host: every reference resolved against the page's address."""

    def own(page, base):
        out = [urljoin(base, h.strip()) for h in HREF.findall(page or "")] if base else []
        return [u for u in out if urlsplit(u).netloc == urlsplit(base).netloc]

    return pd.Series([own(*x) for x in zip(html, url, strict=True)])


def links(html: Column, url: Column) -> Column:
    """Links of a page to its own host, in order: absolute ones as written, rooted ones with the page's scheme and host."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)), F.trim)
    hrefs = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("mailto:"))
    base = F.regexp_extract(url, r"^([^:]+://[^/?#]*)", 1)
    full = F.transform(hrefs, lambda h: F.when(h.startswith("/"), F.concat(base, h)).otherwise(h))
    return F.filter(full, lambda h: netloc(h) == netloc(url))
