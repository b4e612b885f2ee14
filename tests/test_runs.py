"""Whole crawl steps on hand-written cases, and against plain models of their rules."""

import json
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from tidemill.functions.urls import sitemap_priority
from tidemill.operators import dedup, discovery, frontier, outcome
from tidemill.plans import monitoring
from tidemill.sources import sinks
from tidemill.streaming import crawl_log

AT = "2024-02-01 00:00:00"
ITEMS = "id long, seq long, url string, source_domain string, depth int, attempts int, wait double, allowed boolean, status int, headers map<string,string>, html string, fetch_error string, can_save boolean"


def _page(body, title="A title", extra=""):
    return f"<html lang='en'><head><title>{title}</title></head><body><h1>Heading</h1><article><p>{body}</p>{extra}</article></body></html>"


def _words(seed, n=150):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def done(spark):
    a = _words(1)
    links = "<a href='/news/new-one'>x</a><a href='/news/new-one'>x</a><a href='/news/first'>seen</a><a href='/sitemap.xml'>s</a><a href='/tag/x'>t</a>"
    rows = [
        (1, "http://a.com/news/first", 0, 0, 0.0, True, 200, _page(a, "One"), None, True),
        (2, "http://a.com/news/paused", 0, 0, 42.7, True, 200, _page(_words(2)), None, True),
        (3, "http://a.com/news/closed", 0, 0, None, False, 200, _page(_words(3)), None, True),
        (4, "http://a.com/news/forbidden", 0, 2, None, None, 403, "no", None, True),
        (5, "http://a.com/news/timeout", 0, 0, 0.0, True, 0, None, "timeout", True),
        (6, "http://a.com/x", 0, 0, 0.0, True, 200, _page(_words(6)), None, True),
        (7, "http://a.com/news/short", 0, 0, 0.0, True, 200, _page("too short" + " " * 900, extra="<!-- " + "y" * 400 + " -->"), None, True),
        (8, "http://b.com/news/copy", 0, 0, 0.0, True, 200, _page(a, "Two"), None, True),
        (9, "http://b.com/news/unsaved", 0, 1, 5.0, True, 200, _page(_words(9), "Nine"), None, False),
        (10, "http://a.com/news/linking", 4, 0, 0.0, True, 200, _page(_words(10), "Ten", links), None, None),
        (11, "http://a.com/news/deep", 5, 0, 0.0, True, 200, _page(_words(11), "Eleven", links), None, True),
        (12, "http://a.com/news/known", 0, 0, 0.0, True, 200, _page(_words(12), "Twelve"), None, True),
        (13, "http://A.com/news/first/", 0, 0, 0.0, True, 200, _page(_words(13), "Thirteen"), None, True),
        (14, None, 0, 0, None, None, None, None, None, None),
    ]
    data = [(i, i, u, (u or "").split("/")[2].lower() if u else None, d, t, w, ok, s, {}, h, e, c) for i, u, d, t, w, ok, s, h, e, c in rows]
    existing = spark.createDataFrame([(-1, "http://old.com/k", _words(12), None, None)], "seq long, url string, text string, title string, publish_date string")
    existing = existing.unionByName(spark.createDataFrame([(-2, "http://old.com/h", "Heading\n" + _words(12), None, None)], existing.schema))
    out = outcome.process(spark.createDataFrame(data, ITEMS), F.lit(AT).cast("timestamp"), existing=existing)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/done"
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_every_outcome(done):
    got = {r.id: (r.outcome, r.why) for r in done.collect()}
    assert got[1] == ("saved", None) and got[2] == ("skipped", "domain_backoff") and got[3] == ("skipped", "robots_txt")
    assert got[4] == ("blocked", "forbidden_403") and got[5] == ("blocked", "timeout") and got[14] == ("blocked", None)
    assert got[6] == ("skipped", "classifier:no_article_signal") and got[7] == ("low_quality", "low_quality")
    assert got[8][0] == "duplicate" and got[8][1].startswith("duplicate:duplicate_content:exact_hash:") and len(got[8][1].rsplit(":", 1)[1]) == 12
    assert got[9] == ("error", "save_failed") and got[10][0] == got[11][0] == "saved"
    assert got[12][0] == "duplicate" and got[13] == ("duplicate", "duplicate:duplicate_url:https://a.com/news/first")


def test_queue_events_and_duplicates(done):
    queue = {r.id: r for r in outcome.queue_after(done, F.lit(AT).cast("timestamp")).collect()}
    assert (queue[2].status, queue[2].defer_seconds, queue[2].attempts, queue[2].last_error) == ("pending", 43, 0, None)
    assert (queue[4].status, queue[4].attempts, queue[4].defer_seconds) == ("failed", 3, 120) and (queue[5].status, queue[5].defer_seconds) == ("pending", 30)
    assert queue[8].status == "done" and queue[8].article_id is None and (queue[1].status, queue[1].article_id) == ("done", "1") and queue[9].last_error == "save_failed" and queue[7].status == "skipped"
    events = {}
    for r in outcome.events(done).orderBy("id", "n").collect():
        events.setdefault(r.id, []).append((r.event_type, r.status_code, json.loads(r.details)))
    assert events[2] == [("retry_scheduled", None, {"reason": "domain_backoff", "wait_seconds": 42.7})] and events[3] == [("classified_skip", None, {"reason": "robots_txt"})]
    assert events[4] == [("fetch_started", None, {}), ("blocked", 403, {"block_reason": "forbidden_403", "attempt": 3, "next_backoff": 120})]
    assert events[5][1][0] == "fetch_failed" and events[7][1] == ("low_quality", None, {"quality_score": 0.0}) and events[1][1][0] == "saved" and events[9][1] == ("error", None, {"error": "save_failed"})
    dups = {r.url: r for r in outcome.duplicates(done).collect()}
    assert dups["http://b.com/news/copy"].dup_type == "exact_content" and dups["http://b.com/news/copy"].duplicate_of == "https://a.com/news/first"
    assert dups["http://A.com/news/first/"].duplicate_of_compat == "//a.com/news/first"
    assert {r.id for r in outcome.articles(done, F.lit(AT).cast("timestamp")).collect()} == {"1", "10", "11"}


def test_links_and_summary(done, spark):
    got = sorted((r.url, r.depth, r.inserted) for r in outcome.discovered(done).collect())
    assert got == [("http://a.com/news/new-one", 5, False), ("http://a.com/news/new-one", 5, True)]
    seen = spark.createDataFrame([("https://a.com/news/new-one",)], "url_key string")
    assert outcome.discovered(done, seen).count() == 0
    r = outcome.summary(done).first()
    assert (r.total_fetched, r.total_blocked, r.skipped_by_classifier, r.articles_extracted, r.duplicates_removed, r.low_quality_dropped) == (12, 1, 2, 3, 3, 1)
    assert r.block_reasons == {"forbidden_403": 1} and r.dupe_breakdown == {"duplicate_content": 2, "duplicate_url": 1} and r.duplicate_rate == "50.0%" and r.block_rate == "8.3%"
    none = outcome.summary(done.limit(0)).first()
    assert none.total_fetched == 0 and none.block_reasons == {} and none.success_rate == "100.0%" and none.avg_quality_score == 0.0


def test_warm_dedup_keeps_existing_whatever_they_share(spark):
    kind = "seq long, url string, text string, title string, publish_date string"
    old = spark.createDataFrame([(-3, "http://a/1", "x", None, None), (-2, "http://a/1", "y", "T", "2024-01-01"), (-1, "http://a/2", "x", None, None)], kind)
    new = spark.createDataFrame([(1, "http://a/1", "z", None, None), (2, "http://a/3", "y", None, None), (3, "http://a/4", "w", "t", "2024-01-01"), (4, "http://a/5", None, None, None), (5, "http://a/6", "z", None, None)], kind)
    got = {r.seq: (r.dup_type, r.duplicate_of, r.original_key) for r in dedup.layered(new, near=False, existing=old).collect()}
    assert got == {1: ("url", -3, "https://a/1"), 2: ("exact_content", -2, "https://a/1"), 3: ("near_content", -2, "https://a/1"), 4: (None, None, None), 5: (None, None, None)}


def _xml(urls):
    return "<?xml version='1.0'?><urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def test_sources_in_order(spark):
    df = spark.createDataFrame([("a.com", ["https://a.com/sitemap.xml", "https://a.com/special-news-sitemap.xml"])], "d string, s array<string>")
    got = df.select(discovery.source_list(F.col("d"), F.col("s")).alias("x"), discovery.source_list(F.col("d"), legacy=True).alias("y")).first()
    assert len(got.x) == len(set(got.x)) == 16 and got.x[0] == "https://a.com/feed" and got.x[-1] == "https://a.com/sitemap_index.xml" and got.y[0] == "https://a.com/sitemap.xml"
    names = ["http://a/newsfeed.xml", "http://a/feed", "http://a/news-sitemap.xml", "http://a/sitemap.xml/", "http://a/sitemap-3.xml"]
    native = [r.p for r in spark.createDataFrame([(n,) for n in names], "u string").select(sitemap_priority(F.col("u")).alias("p")).collect()]
    assert native == [2, 0, 1, 3, 2]


def test_seed_follows_caps_and_nested_sitemaps(spark):
    art = lambda k: f"https://a.com/news/item-{k}"
    texts = {
        "https://a.com/feed": _xml([art(1), art(1), "https://a.com/tag/x"]),
        "https://a.com/sitemap_index.xml": "﻿ " + _xml([f"https://a.com/sitemap-{k}.xml" for k in range(5)] + [art(50)]),
        "https://a.com/sitemap-0.xml": _xml([art(2), "https://a.com/news-sitemap-9.xml"]),
        "https://a.com/sitemap-1.xml": _xml([art(3)]),
        "https://a.com/sitemap-3.xml": _xml([art(99)]),
        "https://b.com/rss": _xml([f"https://b.com/news/n-{k}" for k in range(60)]),
        "https://c.com/rss": "<html>",
    }
    fetched = spark.createDataFrame([(u, 200, t) for u, t in texts.items()] + [("https://c.com/feed", 404, _xml([art(7)]))], "url string, status int, text string")
    domains = spark.createDataFrame([("a.com", None), ("b.com", []), ("c.com", ["https://c.com/other.xml"])], "domain string, declared array<string>")
    got = {}
    for r in discovery.seed(domains, fetched).orderBy("domain", "pos").collect():
        got.setdefault(r.domain, []).append(r.url)
    # Three nested sitemaps are followed: 0, 1 and 2; 3 and what 0 names come too late.
    assert got["a.com"] == [art(1), art(1), art(50), art(2), art(3)] and got["b.com"] == [f"https://b.com/news/n-{k}" for k in range(40)] and "c.com" not in got
    seen = spark.createDataFrame([("https://a.com/news/item-1",)], "url_key string")
    assert [r.url for r in discovery.seed(domains, fetched, seen=seen).where("domain = 'a.com'").orderBy("pos").collect()] == [art(50), art(2), art(3)]
    assert discovery.seed(domains.limit(0), fetched).count() == 0


def test_stream_breaker_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), 1_700_000_000 + i // 2, rng.choice(["blocked", "blocked", "saved"])) for i in range(200)]
    log = spark.createDataFrame(data, "id long, domain string, s long, kind string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k in range(4):
        log.where((F.col("id") >= k * 50) & (F.col("id") < k * 50 + 50)).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    last = crawl_log.drain(crawl_log.breaker(stream, trip=2), "update").groupBy("domain").agg(F.max_by(F.struct("total_fetched", "total_blocked", "consecutive_failures", "max_run", "blocked_until"), "batch").alias("r")).select("domain", "r.*")
    want = frontier.breaker(log.withColumn("blocked", F.col("kind") == "blocked"), trip=2).select(*last.columns)
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_dedup_and_append(spark, tmp_path):
    log = spark.createDataFrame([(i % 5, 1_700_000_000 + i, "a", "saved") for i in range(10)], "id long, s long, domain string, kind string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    log.write.parquet(f"{tmp_path}/in")
    stream = crawl_log.read_log(spark, f"{tmp_path}/in")
    assert sorted(r.id for r in crawl_log.drain(crawl_log.once(stream)).collect()) == [0, 1, 2, 3, 4]
    sliding = crawl_log.drain(crawl_log.counts(stream, "10 seconds", "5 seconds"), "complete")
    assert sliding.agg(F.sum("n")).first()[0] == 20
    for _ in range(2):
        crawl_log.append(stream, f"{tmp_path}/out", f"{tmp_path}/point").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_monitoring_details(spark):
    ev = spark.createDataFrame([("a", "blocked", "x"), ("a", "blocked", None), ("a", "blocked", "x"), ("b", "saved", None)], "domain string, kind string, reason string")
    r = monitoring.blocked(ev).first()
    assert (r.domain, r.blocked_count, r.reasons) == ("a", 3, '["x",null]')
    assert monitoring.success(ev).first().success_pct is None
    q = spark.createDataFrame([("u", "pending", 1, 3), ("u", "odd", 5, 3), ("v", None, 0, 3)], "url string, status string, attempts int, max_attempts int")
    assert tuple(monitoring.constraint_violations(q).first()) == (2, 1, 1)
    assert tuple(monitoring.constraint_violations(q.limit(0)).first()) == (0, 0, 0)


def test_settle_and_sinks(spark, done, tmp_path):
    q = spark.createDataFrame([(1, "in_progress", "old", None), (2, "in_progress", None, "a2"), (3, "pending", None, None)], "id long, status string, last_error string, article_id string")
    new = spark.createDataFrame([(1, "done", None, "a1"), (2, "skipped", "why", None)], q.schema)
    assert sorted(map(tuple, frontier.settle(q, new).collect())) == [(1, "done", "old", "a1"), (2, "skipped", "why", "a2"), (3, "pending", None, None)]
    for _ in range(2):
        sinks.json_lines(outcome.articles(done, F.lit(AT).cast("timestamp")), f"{tmp_path}/articles")
        sinks.stats(outcome.summary(done), f"{tmp_path}/stats")
        sinks.append(outcome.events(done), f"{tmp_path}/events")
    lines = spark.read.json(f"{tmp_path}/articles")
    assert lines.count() == 3 and "author" in lines.columns and spark.read.json(f"{tmp_path}/stats").first().total_fetched == 12
    assert spark.read.parquet(f"{tmp_path}/events").count() == 2 * outcome.events(done).count()
