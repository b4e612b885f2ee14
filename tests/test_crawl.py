"""Crawl operators on hand-written cases, and the queries against their SQL."""

import collections
import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from tidemill.functions import blocks, html, text, urls
from tidemill.operators import dedup, discovery, frontier, outcome
from tidemill.plans import queries
from tidemill.sources import feeds

TABLES = "documents pages events orders benchmark".split()


def col(spark, values, f, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x")).alias("v")).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: tuple((c, f"{v:.9g}" if isinstance(v, float) else str(v)) for c, v in sorted(r.items()))
    got = [r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()]
    assert collections.Counter(map(key, got)) == collections.Counter(map(key, want))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    # The smallest table has no two articles alike; test_runs.py has some.
    assert queries.queries()[name](spark, sf_dir).count() > 0 or name == "outcome_duplicates"


def test_normalize_url(spark):
    cases = {
        "http://WWW.A.com:80/x/amp/": "https://a.com/x", "a.com": "https://a.com/", "": "", None: "", "https://a.com:8080//b//c?b=2&a=1&utm_source=z&e=#f": "https://a.com:8080/b/c?a=1&b=2",
        "http://u:p@m.a.com/Print/X": "https://m.a.com/X", "http://a.com/?q=a+b%20c~*": "https://a.com/?q=a+b+c~%2A", "http://a.com/?x=%zz": "https://a.com/?x=%25zz", "http://[::1]:8080/x": "https://::1:8080/x", "https://u@[2001:DB8::2]/y": "https://2001:db8::2/y", "a.com/x?u=http://b": "https:///a.com/x?u=http%3A%2F%2Fb",
    }
    keys = list(cases)
    got = col(spark, keys, urls.normalize_url)
    assert got == [cases[k] for k in keys]
    again = [g for g in got if "::" not in g and ":///" not in g]
    assert col(spark, again, urls.normalize_url) == again


def test_classify_url(spark):
    cases = {
        "http://a.com/tag/x": "junk_path_segment", "http://a.com/x/page/2": "junk_path_segment", "http://a.com/x?page=2": "pagination", "http://a.com/2026/06/": "pagination", "http://a.com/2026/06": "calendar_trap",
        "http://a.com/a?s=x": "junk_query_param:s", "http://a.com/a?s=": "no_article_signal", "http://a.com/a?S=x": "no_article_signal", "http://a.com/news-today": "article_path_hint", "http://a.com/some-title": "article_slug",
        "http://a.com/%E8%A8%98%E4%BA%8B": "article_slug", "http://a.com/abc": "no_article_signal", "http://a.com/p/3": "pagination",
    }
    assert col(spark, list(cases), lambda c: urls.classify_url(c)["reason"]) == list(cases.values())


def test_blocks(spark):
    data = [(0, 429, "x", {}), (1, 200, "Unusual Traffic " + "y" * 5000, {}), (2, 200, "Just a moment" + "y" * 400, {"cf-ray": "1"}), (3, 200, "hcaptcha" + "y" * 400, {}), (4, 200, "hcaptcha" + "y" * 4000, {}), (5, 200, "Zugriff verweigert" + "y" * 400, {}), (6, 200, None, {}), (7, 404, "z", {})]
    df = spark.createDataFrame(data, "i int, status int, html string, headers map<string,string>").orderBy("i")
    c = [F.col(x) for x in ("status", "html", "headers")]
    got = df.select(blocks.detect_block(*c)["reason"].alias("a"), blocks.detect_block_legacy(*c)["reason"].alias("b")).collect()
    assert [r.a for r in got] == ["rate_limited_429", "bot_wall", "cloudflare_challenge", "captcha", None, "access_denied", "suspicious_empty_body", None]
    assert [r.b for r in got] == ["http_429", None, "cloudflare_challenge", "captcha", "captcha", "access_denied", "suspicious_empty", None]


def test_html_metadata(spark):
    page = """<html lang="EN-us"><head><title>T</title><link rel="canonical" href="http://c/x"><meta property="og:title" content="O1"><meta property="og:title" content="O2">
    <meta property='og:type' content='My Article'><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"NewsArticle","headline":"H","author":[{"name":"Ann"}],"datePublished":"2024-01-05"}]</script></head>
    <body><h2>Second</h2><h1>First <b>one</b></h1><h3>abc</h3><a href="/r">r</a><a href="#x">x</a><a href='http://other/x'>o</a></body></html>"""
    df = spark.createDataFrame([(page, "http://s/x")], "html string, url string")
    h, u = F.col("html"), F.col("url")
    r = df.select(html.jsonld_meta(h).alias("ld"), html.og_map(h).alias("og"), html.canonical_url(h, u).alias("c"), html.headings(h).alias("hs"), html.author(html.jsonld_meta(h)).alias("who"), html.classify_page(h, u)["reason"].alias("why"), html.links(h, u).alias("links"), html.body_text(h).alias("body")).first()
    assert '"H"' in r.ld and r.og == {"title": "O2", "type": "My Article"} and r.c == "http://c/x" and r.hs == ["First one", "Second"] and r.who == "Ann" and r.why == "og_type_article" and r.links == ["http://s/r"] and r.body is None


def test_text_scores(spark):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert col(spark, ["2024-01-25", "2024-01-24T12:00:00Z", "2023-02-01", "2030-01-01", "x", None, "2024/1/30"], lambda c: text.freshness(c, at)) == [1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert col(spark, ["A. B! 。 C", "", "..."], text.sentence_count) == [3, 0, 0]
    assert col(spark, ["Big News! | Site | X", "  ", None], text.norm_title) == ["big news site", None, None]
    assert col(spark, ["a b c d", "a b", "記事　記事"], text.shingles)[:2] == [["a b c", "b c d"], ["a b"]]
    assert dedup.windows("A b  c d") == {"a b c", "b c d"} and dedup.windows("記事 記事") == {"記事記", "事記事"} and dedup.windows("a b") == {"a b"}
    assert col(spark, ["the cat and the dog sat in the sun and it was good for all of them"], text.detect_language) == ["en"]
    assert col(spark, ["cafÃ© ‘q’", "cafÃ© and é", "cafÃ©", "plain é", "a\x00b ﬁn", None, "Ã", "ðŸ"], text.repair) == ["cafÃ© 'q'", "cafÃ© and é", "café", "plain é", "ab fin", None, "Ã", "ðŸ"]
    assert col(spark, [["a", "", "b "], [], ["", ""], None], text.join_translated, "array<string>") == ["a b", None, None, None]


def test_parse_date_forms(spark):
    got = col(spark, ["2024-01-25T10:11:12+02:00", "2024-1-5", "2024/1/5", "20240125", "20240125T101112Z", "20240125T1011+0200", "2024-W04-4", "2024W044", "2020-W53-7", "2024-W01", "25.1.2024", "", None, "99999999"], lambda c: text.parse_date(c).cast("string"))
    assert got[:10] == ["2024-01-25 10:11:12", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-25 00:00:00", "2024-01-25 10:11:12", "2024-01-25 08:11:00", "2024-01-25 00:00:00", "2024-01-25 00:00:00", "2021-01-03 00:00:00", "2024-01-01 00:00:00"] and got[10:] == [None] * 4


def test_backoff_stops_doubling(spark):
    assert col(spark, [0, 1, 5, 70, None], urls.retry_backoff, "int") == [30, 60, 960, 30 << 30, None]


def test_feeds(spark):
    xml = '﻿<?xml version="1.0"?><rss><channel><item><link>http://a/1</link><guid>http://a/g</guid></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><link href="http://a/s" rel="self"/><link href="http://a/2"/></feed>'
    assert col(spark, [xml, atom, "<bad", None], feeds.feed_urls) == [["http://a/1", "http://a/g"], ["http://a/2"], [], []]
    assert col(spark, ["SiteMap: http://a/s.xml\nsitemap: /rel\r\nX: y"], feeds.robots_sitemaps) == [["http://a/s.xml"]]
    assert col(spark, [xml, "  <html>"], feeds.is_xml) == [True, False]
    df = spark.createDataFrame([("User-agent: *\nDisallow: /x", "http://a/x/1"), ("User-agent: *\nDisallow: /x", "http://a/y"), (None, "http://a/x")], "r string, u string")
    assert sorted(r[0] for r in df.select(feeds.can_fetch_udf("bot")("r", "u")).collect()) == [False, True, True]


def test_older_engine(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><link href=" http://a/1" rel=""/><link href="http://a/2" rel="self"/></feed>'
    assert col(spark, [atom], feeds.feed_urls_legacy) == [["http://a/1"]] and col(spark, [atom], feeds.feed_urls) == [[]]
    assert col(spark, ["http://a/Sitemap-1.xml", "http://a/sitemap", "http://a/x.xml"], feeds.is_sitemap_index) == [True, False, False]
    assert col(spark, ["\n <rss>", "\ufeff<rss>"], feeds.is_xml_legacy) == [True, False]
    assert col(spark, [403, 404, 410, 500, 200], discovery.spider_reads, "int") == [False, False, False, True, True]
    assert col(spark, ["ftp://a/news/x", "http://a/news/sitemap-story", "http://a/tag/x"], outcome.is_spider_candidate) == [False, True, False]
    df = spark.createDataFrame([("<a href='rel/y'>x</a><a href='../up'>x</a><a href='http://o/z'>x</a><a href='//a/w'>x</a>", "http://a/p/q"), (None, None)], "html string, url string")
    assert [r.x for r in df.select(html.resolved_links("html", "url").alias("x")).collect()] == [["http://a/p/rel/y", "http://a/up", "http://a/w"], []]


def test_article_of_a_page_with_metadata(spark):
    body = "One sentence of a story that goes on. " * 12
    page = f"""<html lang="en"><head><title></title><meta property="og:description" content="From og"><meta property="og:title" content="Og">
    <script type="application/ld+json">{{"@type":"BlogPosting","headline":"From data","author":{{"name":"Ann"}},"datePublished":"2024-01-31","description":"d","inLanguage":"FR-ca"}}</script></head><body><article><h1>Long heading</h1><p>{body}</p></article></body></html>"""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    r = spark.createDataFrame([(page, "http://s/x")], "html string, url string").select(html.extract(F.col("html"), F.col("url"), at).alias("a")).select("a.*").first()
    assert (r.title, r.author, r.publish_date, r.language, r.summary, r.content_type, r.canonical_url) == ("From data", "Ann", "2024-01-31", "fr", "From og", "blog", None)
    assert r.quality_score == round(sum(r.quality_reasons.values()), 3) and r.quality_reasons["has_author"] == 0.1 and r.quality_reasons["freshness"] == 0.1


def test_breaker_equals_a_plain_walk(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), rng.randint(0, 5 * 86_400), i, rng.random() < rng.choice([0.2, 0.97])) for i in range(300)] + [("c", k * 40_000, 1000 + k, True) for k in range(9)]
    want = {}
    for d, s, i, bad in sorted(data, key=lambda x: (x[1], x[2])):
        n, b, run, most = want.get(d, (0, 0, 0, 0))
        run = run + 1 if bad else 0
        want[d] = (n + 1, b + bad, run, max(most, run))
    ev = spark.createDataFrame(data, "domain string, s long, id long, blocked boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.domain: (r.total_fetched, r.total_blocked, r.consecutive_failures, r.max_run) for r in frontier.breaker(ev).collect()}
    assert got == want


def test_queue_and_domains(spark):
    q = spark.createDataFrame([(i, f"u{i}", "pending", 0, i % 3, 3) for i in range(5)], "id int, url string, status string, priority int, attempts int, max_attempts int").withColumn("next_attempt_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("next_attempt_at"))
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.id for r in frontier.claim(q, now, 2).collect()] == [0, 1]
    assert [r.status for r in frontier.fail(q, now).orderBy("id").collect()] == ["pending", "pending", "failed", "pending", "pending"]
    new = spark.createDataFrame([(9, "u1"), (10, "n"), (11, "n")], "id int, url string")
    assert {r.id: r.inserted for r in frontier.enqueue(q, new).collect()} == {9: False, 10: True, 11: False}
    ev = spark.createDataFrame([("a", i, i, b) for i, b in enumerate([True, True, False, True, True, True, True])] + [("b", 0, 0, False)], "domain string, s long, id long, blocked boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.domain: r for r in frontier.due(frontier.breaker(ev), F.timestamp_seconds(F.lit(7))).collect()}
    assert (got["a"].consecutive_failures, got["a"].max_run, got["a"].action, got["a"].defer_seconds) == (4, 4, "defer", 300) and got["b"].action == "go"
    arts = spark.createDataFrame([("i1", "u", "d", "old", 1)], "id string, url string, source_domain string, title string, s long").withColumn("crawled_at", F.timestamp_seconds("s"))
    newer = spark.createDataFrame([("i2", "u", "e", "new", 2)], "id string, url string, source_domain string, title string, s long").withColumn("crawled_at", F.timestamp_seconds("s"))
    r = frontier.upsert(arts, newer).first()
    assert (r.id, r.source_domain, r.title) == ("i1", "d", "new")


def test_layered_dedup_with_near_copies_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    data = []
    for i in range(40):
        w = list(base if i % 2 else base[::-1])
        for at in rng.sample(range(300), rng.choice([0, 1, 3, 9, 30])):
            w[at] = f"new{i}x{at}"
        data.append((i, f"http://a/{rng.randint(0, 60)}", " ".join(w), None, None))
    bands = [set(enumerate(b)) for b in next(dedup.minhash_bands.func(iter([__import__("pandas").Series([r[2] for r in data])])))]
    urls_seen, kept, want = set(), [], {}
    for (i, u, t, _, _), own in zip(data, bands, strict=True):
        exact, near = [k for k in kept if data[k][2] == t], [k for k in kept if bands[k] & own]
        want[i] = "url" if u in urls_seen else "exact_content" if exact else "near_content" if near else None
        if want[i] is None:
            kept.append(i)
        urls_seen.add(u)
    got = dedup.layered(spark.createDataFrame(data, "seq long, url string, text string, title string, publish_date string")).collect()
    assert {r.seq: r.dup_type for r in got} == want and len(set(want.values())) >= 3


def test_layered_dedup_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    for _ in range(3):
        data = [(i, f"http://a/{rng.randint(0, 12)}", f"text {rng.randint(0, 6)}", rng.choice([None, "t1", "t2", "t3"]), rng.choice([None, "2024-01-01", "2024-01-02"])) for i in range(25)]
        seen_u, seen_h, seen_t, want = set(), set(), set(), {}
        for i, u, t, ti, da in data:
            td = (ti, da) if ti and da else None
            why = "url" if u in seen_u else "exact_content" if t in seen_h else "near_content" if td in seen_t and td else None
            seen_u.add(u)
            if why is None:
                seen_h.add(t)
                seen_t.add(td)
            want[i] = why
        got = dedup.layered(spark.createDataFrame(data, "seq long, url string, text string, title string, publish_date string"), near=False).collect()
        assert {r.seq: r.dup_type for r in got} == want and all(r.kept == (r.dup_type is None) for r in got)
