"""What becomes of each claimed url: one wide table of outcomes, from which the queue, the event log, the duplicates and the articles follow.

Tests in this order, the first that holds ends it: domain paused, robots,
blocked or not fetched, page type, quality, duplicate, saved, save failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, html
from ..functions.urls import classify_url, is_sitemap, is_trap, normalize_url, retry_backoff
from ..tables import written
from .dedup import layered

MIN_QUALITY = 0.25
#: Seconds a domain may keep a url waiting before the url is put off.
MAX_WAIT = 10.0
ARTICLE = "canonical_url title author publish_date language summary main_text headings quality_score content_type quality_reasons".split()


def process(items: DataFrame, as_of: Column, *, existing: DataFrame | None = None, min_quality: float = MIN_QUALITY, depth_limit: int = 5, legacy: bool = False) -> DataFrame:
    """items with outcome, why, the article's columns, dup_type, dup_reason, duplicate_of and links.

    items: id, seq (order of processing), url, source_domain, depth, attempts,
    wait (seconds, null: none), allowed (by robots, null: yes), status, headers
    (map), html, fetch_error, can_save (null: yes). existing: articles saved
    before (see layered). legacy: the older engine's block rules, and no dedup
    by title and date. `why` is the reason of every outcome but saved.
    """
    detect = blocks.detect_block_legacy if legacy else blocks.detect_block
    fetched = (F.coalesce("wait", F.lit(0.0)) <= MAX_WAIT) & F.coalesce("allowed", F.lit(True))
    rows = items.withColumn("fetched", fetched).withColumn("b", F.when(F.col("fetched"), detect(F.col("status"), F.coalesce("html", F.lit("")), F.col("headers"))))
    # A page that never came isn't blocked, however empty; its error is the reason.
    refused = F.col("b.blocked") & (F.col("html").isNotNull() | F.col("status").isin(403, 429, 503))
    rows = rows.withColumn("blocked", F.when(F.col("fetched"), refused)).withColumn("block_reason", F.when(F.col("fetched"), F.when(refused, F.col("b.reason")).otherwise(F.col("fetch_error")))).drop("b")
    rows = rows.withColumn("page", F.when(F.col("fetched") & ~F.col("blocked") & F.col("html").isNotNull(), F.col("html")))
    rows = rows.withColumn("c", F.when(F.col("page").isNotNull(), html.classify_page(F.col("page"), F.col("url"))))
    body = F.when(F.col("c.page_type") == "article", F.col("page"))
    rows = rows.withColumn("a", F.when(F.col("c.page_type") == "article", html.extract(F.col("page"), F.col("url"), as_of)))
    own = [c for c in items.columns if c not in ("html", "headers")]
    rows = rows.select(*own, "fetched", "blocked", "block_reason", F.col("page").isNotNull().alias("has_page"), "c.page_type", F.col("c.reason").alias("type_reason"),
        *(F.col(f"a.{k}") for k in ARTICLE), F.when(F.col("depth") < depth_limit, html.links(body, F.col("url"))).alias("links"))
    good = F.col("main_text").isNotNull() & (F.col("quality_score") >= min_quality)
    rows = written(rows.withColumn("good", F.coalesce(good, F.lit(False))), "pages-read")
    title, date = (F.lit(None).cast("string"),) * 2 if legacy else (F.col("title"), F.col("publish_date"))
    fresh = rows.where("good").select("seq", F.coalesce("canonical_url", "url").alias("url"), F.col("main_text").alias("text"), title.alias("title"), date.alias("publish_date"))
    dup = layered(fresh, existing=existing)
    dup = written(dup.select(F.col("seq").alias("__seq"), "url_key", "reason", "dup_type", F.col("duplicate_of").alias("original"), "original_key"), "duplicates-found")
    rows = rows.join(dup, rows["seq"] == dup["__seq"], "left").drop("__seq")
    tail = F.when(F.col("dup_type") == "exact_content", F.substring(F.sha2("main_text", 256), 1, 12)).otherwise(F.col("original_key"))
    rows = rows.withColumn("dup_reason", F.concat(F.col("reason"), F.lit(":"), tail)).drop("reason")
    paused, robots = F.coalesce("wait", F.lit(0.0)) > MAX_WAIT, ~F.coalesce("allowed", F.lit(True))
    out = lambda kind, why: F.struct(F.lit(kind).alias("outcome"), why.cast("string").alias("why"))
    end = (
        F.when(paused, out("skipped", F.lit("domain_backoff"))).when(robots, out("skipped", F.lit("robots_txt")))
        .when(~F.col("has_page"), out("blocked", F.col("block_reason")))
        .when(F.col("page_type") != "article", out("skipped", F.concat(F.lit("classifier:"), F.col("type_reason"))))
        .when(~F.col("good"), out("low_quality", F.lit("low_quality")))
        .when(F.col("dup_reason").isNotNull(), out("duplicate", F.concat(F.lit("duplicate:"), F.col("dup_reason"))))
        .when(F.coalesce("can_save", F.lit(True)), out("saved", F.lit(None))).otherwise(out("error", F.lit("save_failed")))
    )
    return rows.withColumn("end", end).select(*own, "fetched", "blocked", "block_reason", *ARTICLE, "url_key", "dup_type", "dup_reason", F.col("original").alias("duplicate_of"), "original_key", "links", "end.outcome", "end.why")


def queue_after(done: DataFrame, as_of: Column, max_attempts: int = 3) -> DataFrame:
    """id, status, attempts, last_error, defer_seconds, next_attempt_at and article_id of each processed row; null: as before."""
    paused, failed = F.col("why") == "domain_backoff", F.col("outcome").isin("blocked", "error")
    status = (
        F.when(F.coalesce(paused, F.lit(False)), "pending").when(failed, F.when(F.col("attempts") + 1 >= max_attempts, "failed").otherwise("pending"))
        .when(F.col("outcome").isin("skipped", "low_quality"), "skipped").otherwise("done")
    )
    later = F.when(F.coalesce(paused, F.lit(False)), F.floor("wait").cast("long") + 1).when(failed, retry_backoff(F.col("attempts")))
    return done.select(
        "id", status.alias("status"), F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~F.coalesce(paused, F.lit(False)), F.col("why")).alias("last_error"), later.alias("defer_seconds"),
        F.timestamp_seconds(F.unix_timestamp(as_of) + later).alias("next_attempt_at"), F.when(F.col("outcome") == "saved", F.col("id").cast("string")).alias("article_id"),
    )


def events(done: DataFrame) -> DataFrame:
    """id, n (order within the url), event_type, url, source_domain, status_code, details (JSON): what is logged of each row."""
    js = lambda **kw: F.to_json(F.struct(*(v.alias(k) for k, v in kw.items())))
    event = lambda kind, details, code=None: F.struct(kind.alias("event_type"), (F.lit(None).cast("int") if code is None else code.cast("int")).alias("status_code"), details.alias("details"))
    why, kind = F.col("why"), F.col("outcome")
    last = (
        F.when(why == "domain_backoff", event(F.lit("retry_scheduled"), js(reason=why, wait_seconds=F.round("wait", 1))))
        .when(kind == "skipped", event(F.lit("classified_skip"), js(reason=F.regexp_replace(why, "^classifier:", ""))))
        .when(kind == "blocked", event(F.when(F.col("blocked"), "blocked").otherwise("fetch_failed"), js(block_reason=F.col("block_reason"), attempt=F.col("attempts") + 1, next_backoff=retry_backoff(F.col("attempts"))), F.col("status")))
        .when(kind == "low_quality", event(F.lit("low_quality"), js(quality_score=F.when(F.col("main_text").isNotNull(), F.col("quality_score")).otherwise(0.0))))
        .when(kind == "duplicate", event(F.lit("duplicate"), js(dup_type=F.col("dup_type"), reason=F.col("dup_reason"))))
        .when(kind == "saved", event(F.lit("saved"), js(quality_score=F.col("quality_score"), language=F.col("language"))))
        .otherwise(event(F.lit("error"), js(error=why)))
    )
    start = F.when(F.col("fetched"), event(F.lit("fetch_started"), F.lit("{}")))
    every = F.filter(F.array(start, last), lambda e: e.isNotNull())
    return done.select("id", "url", "source_domain", F.posexplode(every).alias("n", "e")).select("id", "n", "e.event_type", "url", "source_domain", "e.status_code", "e.details")


def duplicates(done: DataFrame) -> DataFrame:
    """A row for each duplicate; duplicate_of names the original's key whole, duplicate_of_compat what follows the last colon."""
    return done.where("outcome = 'duplicate'").select("url", "canonical_url", "source_domain", "dup_type", F.col("original_key").alias("duplicate_of"), F.substring_index("dup_reason", ":", -1).alias("duplicate_of_compat"), F.to_json(F.struct(F.col("dup_reason").alias("reason"))).alias("details"))


def articles(done: DataFrame, as_of: Column) -> DataFrame:
    return done.where("outcome = 'saved'").select(F.col("id").cast("string").alias("id"), "url", "source_domain", *ARTICLE, as_of.alias("crawled_at"))


def is_candidate(url: Column) -> Column:
    """Neither a trap nor a sitemap, and an article by its address."""
    return ~is_trap(url) & ~is_sitemap(url) & (classify_url(url)["page_type"] == "article")


def is_spider_candidate(url: Column) -> Column:
    """The older engine's rule: it takes sitemaps by their name too, if their address passes."""
    return url.startswith("http") & ~is_trap(url) & (classify_url(url)["page_type"] == "article")


def discovered(done: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """url, source_domain, depth, discovered_from, pos and inserted: links of saved pages whose key no page up to then had.

    seen (url_key): keys of earlier runs. inserted marks the first of each url
    as written; repeats count as found all the same.
    """
    found = done.where("outcome = 'saved'").select("seq", F.col("url").alias("discovered_from"), "source_domain", (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("pos", "url"))
    found = found.where(is_candidate(F.col("url"))).withColumn("key", normalize_url(F.col("url")))
    known = done.where("url_key is not null").groupBy("url_key").agg(F.min("seq").alias("since"))
    if seen is not None:
        known = known.unionByName(seen.select("url_key", F.lit(None).cast("long").alias("since")))
        known = known.groupBy("url_key").agg(F.min(F.coalesce("since", F.lit(-(2**62)))).alias("since"))
    found = found.join(known, found["key"] == known["url_key"], "left").where("since is null or since > seq").drop("url_key", "since")
    at = F.struct("seq", "pos")
    first = found.groupBy("url").agg(F.min(at).alias("__first"))
    return found.join(first, "url").withColumn("inserted", at == F.col("__first")).select("url", "key", "source_domain", "depth", "discovered_from", "pos", "inserted")


def summary(done: DataFrame) -> DataFrame:
    """One row: counters, rates, averages and counts by reason of a run."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    saved, score = F.col("outcome") == "saved", F.col("quality_score")
    share = lambda a, b: F.format_string("%.1f%%", a * 100.0 / F.greatest(b, F.lit(1)))
    totals = done.agg(
        F.count_distinct(F.when(F.col("fetched"), F.col("source_domain"))).alias("domains_crawled"), n(F.col("fetched")).alias("total_fetched"), n(F.col("blocked")).alias("total_blocked"),
        n((F.col("outcome") == "skipped") & (F.col("why") != "domain_backoff")).alias("skipped_by_classifier"), n(saved).alias("articles_extracted"),
        n(F.col("outcome") == "duplicate").alias("duplicates_removed"), n(F.col("outcome") == "low_quality").alias("low_quality_dropped"),
        F.round(F.coalesce(F.avg(F.when(saved, score)), F.lit(0.0)), 3).alias("avg_quality_score"),
        n(saved & (score > 0.7)).alias("high"), n(saved & score.between(0.4, 0.7)).alias("medium"), n(saved & (score < 0.4)).alias("low"),
    ).withColumn("one", F.lit(1))
    # Reasons are few and fixed, so these maps stay small; both tables have one row.
    kinds = done.select(F.explode(F.array(F.struct(F.lit("block").alias("kind"), F.when(F.col("blocked"), F.col("block_reason")).alias("reason")), F.struct(F.lit("dupe").alias("kind"), F.when(F.col("outcome") == "duplicate", F.substring_index("dup_reason", ":", 1)).alias("reason")))).alias("k"))
    kinds = kinds.where("k.reason is not null").groupBy("k.kind", "k.reason").agg(F.count("*").alias("n"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("reason", "n")))))
    maps = kinds.agg(of("block").alias("block_reasons"), of("dupe").alias("dupe_breakdown")).withColumn("one", F.lit(1))
    out = totals.join(maps, "one").drop("one")
    fetched, blocked, dup = F.col("total_fetched"), F.col("total_blocked"), F.col("duplicates_removed")
    return out.withColumns({"success_rate": share(F.greatest(fetched, F.lit(1)) - blocked, fetched), "block_rate": share(blocked, fetched), "duplicate_rate": share(dup, F.col("articles_extracted") + dup)})
