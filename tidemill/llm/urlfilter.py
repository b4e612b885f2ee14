"""URL filters: pattern rules found by their rarest literal token, in DataFrame operations only.

A rule names literal tokens that any url it fits must hold as whole tokens. It
is filed under the one that is rarest among the urls; a url's tokens fetch the
rules filed under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

#: The rules (verdict, host, path) that the query applies.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words that mark a url as advertising or spam where they are whole tokens of it.
SPAM_TOKENS = ("spam-farm", "cheap-pills", "casino", "poker", "porn", "xxx", "viagra", "payday-loans", "click-bait", "free-money", "adserver", "doubleclick")

#: Up to so many filed rules the index is broadcast (some 100 bytes each); beyond, it is shuffled.
BROADCAST_RULES = 100_000
RULE_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>, rank int"


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """Fits the host and its subdomains where the path begins with the rule's; of several the longest counts."""
    tokens = [t for t in re.split(r"[^a-z0-9]+", f"{host}") if t]
    whole = [t.lower() for t in re.findall(r"(?<=/)[A-Za-z0-9]+(?=/)", path)]
    return (host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens + whole, len(host + path))


def token_rule(text: str, verdict: str = "block") -> tuple:
    """Fits urls that hold the text between characters that aren't letters or digits; ranks below every host rule."""
    return (f"*{text}*", verdict, rf"(?i)(?:^|[^a-z0-9]){re.escape(text)}(?:[^a-z0-9]|$)", re.findall("[a-z0-9]+", text), 0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty if the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[tuple], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, pattern_rule, verdict.

    rule is the longest host rule that fits, its verdict counts; without one,
    the url is blocked if a token rule fits (pattern_rule, the first by name)
    and allowed otherwise. Null urls have no tokens and are allowed. Repeated
    rows give repeated rows; other columns are not looked at.
    """
    spark: SparkSession = pages.sparkSession
    rules = spark.createDataFrame(list(rules), RULE_SCHEMA)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    host, path = split_url(F.col("url"))
    urls = urls.select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", F.array_distinct(F.split(F.lower(F.concat_ws("/", "host", "path", F.regexp_extract(F.coalesce("url", F.lit("")), r"\?(.*)$", 1))), "[^a-z0-9]+")))
    named = rules.select("rule", F.explode("tokens").alias("token"))
    wanted = named.select("token").distinct()
    freq = urls.select("copies", F.explode("tokens").alias("token")).join(F.broadcast(wanted) if rules.count() <= BROADCAST_RULES else wanted, "token").groupBy("token").agg(F.sum("copies").alias("freq"))
    filed = named.join(freq, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), "token"))["token"].alias("token"))
    index = materialize(rules.join(filed, "rule").select(F.col("token").alias("r_token"), "rule", "verdict", "pattern", "rank"), "rule-index")
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    asked = urls.withColumn("token", F.explode_outer("tokens")).drop("tokens")
    subject = F.when(F.col("rank") > 0, F.concat("host", "path")).otherwise(F.concat_ws("", "host", "path", F.regexp_extract(F.coalesce("url", F.lit("")), r"(\?.*)$", 1)))
    fits = F.when(F.col("pattern").isNotNull(), F.expr("__subject rlike pattern"))
    met = asked.join(index, asked["token"] == index["r_token"], "left").withColumn("__subject", subject).withColumn("fits", F.coalesce(fits, F.lit(False)))
    own = F.col("fits") & (F.col("rank") > 0)
    best = met.groupBy("page_id", "url", "copies", "host", "path").agg(
        F.max(F.when(own, F.struct("rank", "rule", "verdict"))).alias("best"),
        F.min(F.when(F.col("fits") & (F.col("rank") == 0), F.struct("rule", "verdict"))).alias("also"),
    )
    verdict = F.coalesce("best.verdict", "also.verdict", F.lit("allow"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best").isNull(), F.col("also.rule")).alias("pattern_rule"), verdict.alias("verdict"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
