"""Line dedup by site-relative frequency.

Within a host, the pages that hold a line are divided by the host's pages;
lines above a boilerplate ratio are dropped from all its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key

#: Share of a host's pages from which a line is boilerplate, and pages that must hold it at the least.
RATIO, MIN_PAGES = 0.03, 3


def _key(line: Column) -> Column:
    """What makes two lines the same: all but the white space at their ends; blank lines have none."""
    bare = F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))
    return F.when(bare != "", F.md5(bare))


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line): md5 of lines on more than `ratio` of the host's pages, and on at least min_pages of them.

    A page is a row or, with copies_once, a distinct text of the host.
    """
    keys = F.array_distinct(F.transform(F.split(text_col, "\n"), _key))
    pages = F.count_distinct("page") if copies_once else F.count("*")
    page = (text_key(F.col(text_col)) if copies_once else F.lit(0)).alias("page")
    lines = docs.select(F.col(host_col).alias("host"), page, F.explode(keys).alias("line")).where(F.col("line").isNotNull())
    on = lines.groupBy("host", "line").agg(pages.alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.select(F.col(host_col).alias("t_host"), page).groupBy("t_host").agg(pages.alias("total"))
    totals = materialize(totals, "host-pages")
    return on.join(totals, on["host"].eqNullSafe(totals["t_host"])).where(F.col("pages") > F.col("total") * F.lit(float(ratio))).select("host", "line")


def drop_boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """docs with boilerplate lines cut from the text, and __n_lines, __n_dropped; rows are kept even if nothing is left.

    Blank lines are neither counted nor dropped. Null hosts are one host. Null
    texts stay null and have no lines, but count as pages. Hosts of few pages
    lose nothing, for want of min_pages. Other columns are untouched.
    """
    # A line on more than `ratio` of a host's pages: a host has fewer of them than its lines per page divided by ratio.
    drop = boilerplate(docs, text_col=text_col, host_col=host_col, ratio=ratio, min_pages=min_pages, copies_once=copies_once).groupBy("host").agg(F.collect_set("line").alias("__drop"))
    drop = materialize(drop.select(F.col("host").alias("__host"), "__drop"), "boilerplate")
    out = docs.join(drop, docs[host_col].eqNullSafe(drop["__host"]), "left")
    parts = F.split(docs[text_col], "\n")
    kept = F.when(F.col("__drop").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col("__drop"), _key(x)), F.lit(False))))
    n = F.coalesce(F.size(parts), F.lit(0))
    out = out.withColumn("__kept", kept).withColumn("__n_lines", F.when(docs[text_col].isNull(), 0).otherwise(n).cast("long"))
    out = out.withColumn("__n_dropped", F.when(F.col("__drop").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__kept")).cast("long"))
    text = F.when(F.col("__drop").isNull(), docs[text_col]).otherwise(F.array_join("__kept", "\n"))
    return out.withColumn(text_col, text).select(*docs.columns, "__n_lines", "__n_dropped")
