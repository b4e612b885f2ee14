"""Discovery sources: robots lines, paths to try, sitemaps and feeds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType


def clean_xml(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x{FEFF}\x{FFFE} \t\r\n]+", "")


def is_xml(text: Column) -> Column:
    bare = clean_xml(text)
    return bare.startswith("<?xml") | bare.startswith("<rss") | bare.startswith("<feed")


def is_xml_legacy(text: Column) -> Column:
    """The older engine's test: white space goes, a byte order mark doesn't."""
    bare = F.regexp_replace(text, r"^\s+", "")
    return bare.startswith("<?xml") | bare.startswith("<rss") | bare.startswith("<feed")


def is_sitemap_index(url: Column) -> Column:
    """The older engine's mark of a sitemap to follow."""
    return F.contains(F.lower(url), F.lit("sitemap")) & url.endswith(".xml")


def robots_sitemaps(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: F.lower(x).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda x: x.startswith("http"))


@F.pandas_udf(ArrayType(StringType()))
def feed_urls(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """URLs of a sitemap or feed in document order; none for what can't be parsed."""
    for part in texts:
        yield part.map(_urls_of)


@F.pandas_udf(ArrayType(StringType()))
def feed_urls_legacy(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As feed_urls; links with an empty rel count too."""
    for part in texts:
        yield part.map(lambda t: _urls_of(t, ("alternate", "")))


def _urls_of(text: str | None, rels: tuple[str, ...] = ("alternate",)) -> list[str]:
    try:
        root = ET.fromstring((text or "").lstrip("﻿￾ \t\r\n").encode())
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        name, value = str(node.tag).rsplit("}", 1)[-1], (node.text or "").strip()
        if name == "loc" and value or name in ("link", "guid") and value.startswith("http"):
            out.append(value)
        elif name == "link" and node.get("href", "").strip().startswith("http") and node.get("rel", "alternate") in rels:
            out.append(node.get("href").strip())
    return out


def can_fetch_udf(agent: str):
    """Whether a robots text (null: none) lets agent fetch a url."""

    @F.pandas_udf(BooleanType())
    def can_fetch(robots: pd.Series, url: pd.Series) -> pd.Series:
        rules: dict = {}

        def ask(text, u):
            if text is None:
                return True
            if text not in rules:
                rules[text] = RobotFileParser()
                rules[text].parse(text.splitlines())
            return rules[text].can_fetch(agent, u)

        return pd.Series([ask(a, b) for a, b in zip(robots, url, strict=True)])

    return can_fetch
