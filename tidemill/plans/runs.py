"""Queries of whole crawl steps over the driver's tables: outcomes, discovery, domain waits, articles and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, html, text, urls
from ..operators import dedup, discovery, frontier, outcome
from ..streaming import crawl_log
from . import oracles

NET = oracles.NET


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages read as fetched queue rows; remainders of page_id stand for waits, robots, status and failed saves."""
    p, i = _pages(spark, sf_dir), F.col("page_id")
    return p.select(
        i.alias("id"), i.alias("seq"), "url", urls.netloc(F.col("url")).alias("source_domain"), (i % 7).cast("int").alias("depth"), (i % 3).cast("int").alias("attempts"),
        F.when(i % 23 == 0, 42.7).otherwise(0.0).alias("wait"), (i % 17 != 0).alias("allowed"), F.when(i % 29 == 0, 403).when(i % 31 == 0, 0).otherwise(200).alias("status"),
        F.create_map(F.lit("server"), F.lit("x")).alias("headers"), F.when(i % 31 != 0, F.col("html")).alias("html"), F.when(i % 31 == 0, "timeout").alias("fetch_error"), (i % 37 != 0).alias("can_save"),
    )


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(urls.netloc(F.col("url")).alias("domain")).where("domain <> ''").distinct()


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each host, of its pages' urls: what reading /feed would give."""
    p = _pages(spark, sf_dir).select(urls.netloc(F.col("url")).alias("domain"), F.regexp_replace("url", "&", "&amp;").alias("u"), "page_id").where("domain <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda r: F.concat(F.lit("<url><loc>"), r["u"], F.lit("</loc></url>"))), "")
    return p.groupBy("domain").agg(body.alias("b")).select(F.concat(F.lit("https://"), "domain", F.lit("/feed")).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<?xml version='1.0'?><urlset>"), "b", F.lit("</urlset>")).alias("text"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = crawl_log.read_log(spark, f"{sf_dir}/events.parquet")
    return log.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("user_id").alias("domain"), F.when(F.col("event_type") == "error", "blocked").otherwise(F.col("event_type")).alias("kind"))


def build(events, queue, at, now, events_sql: str, queue_sql: str, as_of: str, now_text: str) -> dict:
    """name -> (query, SQL or None)."""
    done = lambda s, d: outcome.process(items(s, d), at())
    page = _pages
    docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
    values = lambda words: ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    sources = f"""WITH h AS (SELECT DISTINCT {NET} AS domain FROM pages WHERE {NET} <> ''), p(i, path) AS (VALUES {values(discovery.PATHS)}),
      s AS (SELECT domain, i, 'https://' || domain || path AS source FROM h, p),
      r AS (SELECT *, CASE WHEN regexp_matches(lower(source), '/feed|/rss|atom|rss2') THEN 0 WHEN contains(lower(source), 'news') AND contains(lower(source), 'sitemap') THEN 1
        WHEN contains(lower(source), 'sitemap_index') OR regexp_matches(lower(source), '/sitemap[.]xml/*$') THEN 3 ELSE 2 END AS prio FROM s)
      SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY prio, i) - 1 AS INTEGER) AS pos, source FROM r"""
    islands = f"""WITH {events_sql}, i AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM e),
      r AS (SELECT domain, island, sum(CASE WHEN kind = 'blocked' THEN 1 ELSE 0 END) AS run, count(*) AS n, max(ts) AS last FROM i GROUP BY ALL),
      g AS (SELECT domain, CAST(sum(n) AS BIGINT) AS total_fetched, CAST(sum(run) AS BIGINT) AS total_blocked, CAST(max_by(run, island) AS BIGINT) AS consecutive_failures, CAST(max(run) AS BIGINT) AS max_run, max(last) AS last FROM r GROUP BY domain)"""
    now_events = "2024-01-31 00:00:00"

    def due(s, d):
        state = frontier.breaker(events(s, d).select("domain", "ts", "id", (F.col("kind") == "blocked").alias("blocked")), trip=1, pause=86_400)
        return frontier.due(state, F.lit(now_events).cast("timestamp")).select("domain", "wait", "action", "defer_seconds")

    def recrawl(s, d):
        arts = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 == 0, "news").when(F.col("o_custkey") % 4 == 1, "blog").when(F.col("o_custkey") % 4 == 2, "wiki").otherwise("article").alias("content_type"), F.col("o_orderdate").cast("timestamp").alias("crawled_at"))
        return frontier.recrawl(queue(s, d), arts, now()).select("id", "status")

    def upsert(s, d):
        rows = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("https://h/"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_domain"), F.col("o_orderstatus").alias("title"), F.struct(F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderkey").alias("k")).alias("crawled_at"))
        old, new = rows.where(F.col("id") % 2 == 0), rows.where(F.col("id") % 2 == 1)
        return frontier.upsert(old, new).select("url", "id", "title")

    def enqueue(s, d):
        found = outcome.discovered(done(s, d))
        return found.select("url", "depth", "discovered_from", "pos", "inserted")

    def warm(s, d):
        rows = docs(s, d).select(F.col("doc_id").alias("seq"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), "text", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("publish_date"))
        bench = s.read.parquet(f"{d}/benchmark.parquet").select((-1 - F.xxhash64(F.col("item_id").cast("string")).bitwiseAND(F.lit(2**40 - 1))).alias("seq"), F.concat(F.lit("https://b/"), F.col("item_id").cast("string")).alias("url"), "text", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("publish_date"))
        return dedup.layered(rows, near=False, existing=bench).select("seq", "kept", "dup_type", F.when(F.col("duplicate_of") >= 0, F.col("duplicate_of")).alias("duplicate_of"))

    word = r"[\p{L}\p{N}_]+"
    ends = text.SENTENCE_ENDS
    uniq = f"""SELECT doc_id, round(CASE WHEN len(w) < 20 OR w IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least((len(list_distinct(w)) / len(w)::DOUBLE - 0.25::DOUBLE) / 0.40::DOUBLE, 1.0::DOUBLE)) END, 6) AS uniqueness, CAST(sentences AS INTEGER) AS sentences FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '{ends}'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) AS sentences, list_slice(regexp_extract_all(lower(text), '{word}'), 1, 400) AS w FROM documents)"""
    low, bare = "lower(coalesce(html, ''))", r"length(regexp_replace(coalesce(html, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'))"
    has = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
    block = f"""SELECT page_id, why IS NOT NULL AS blocked, why AS reason FROM (SELECT page_id, CASE WHEN {has(blocks.WALL_PHRASES)} THEN 'bot_wall' WHEN n < 2000 AND {has(blocks.CAPTCHA.split('|'))} THEN 'captcha'
      WHEN n < 2000 AND {has(blocks.BLOCK_PHRASES)} THEN 'access_denied' WHEN n < 300 THEN 'suspicious_empty_body' END AS why FROM (SELECT page_id, {low} AS low, {bare} AS n FROM pages))"""
    legacy = f"""SELECT page_id, why IS NOT NULL AS blocked, why AS reason FROM (SELECT page_id, CASE WHEN {has(('recaptcha', 'hcaptcha'))} THEN 'captcha' WHEN {has(blocks.BLOCK_PHRASES)} THEN 'access_denied'
      WHEN n < 300 THEN 'suspicious_empty' END AS why FROM (SELECT page_id, {low} AS low, length(coalesce(html, '')) AS n FROM pages))"""
    heads = " || ".join(rf"regexp_extract_all(html, '(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>', 1)" for n in (1, 2, 3))
    heads = rf"""SELECT page_id, array_to_string(list_slice(list_filter(list_transform({heads}, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g'))), lambda x: length(x) > 3), 1, 10), '|') AS headings,
      nullif(regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*["'']?([^"''\s>]+)', 1), '') AS lang FROM pages"""
    stops = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in ws)}], x))) AS n_{c}" for c, ws in sorted(text.STOP.items()))
    langs = sorted(text.STOP)
    best = "greatest(" + ", ".join(f"n_{c}" for c in langs) + ")"
    detect = f"""WITH n AS (SELECT doc_id, length(text) AS len, {stops} FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents))
      SELECT doc_id, CASE WHEN len >= 50 AND {best} > 0 THEN CASE {' '.join(f"WHEN n_{c} = {best} THEN '{c}'" for c in langs)} END END AS language FROM n"""
    after = oracles.outcomes()
    return {
        "page_outcomes": (lambda s, d: done(s, d).select("id", "url", "outcome", "why", "dup_type", "quality_score"), after["page_outcomes"]),
        "outcome_queue": (lambda s, d: outcome.queue_after(done(s, d), at()).select("id", "status", "attempts", "last_error", "defer_seconds"), after["outcome_queue"]),
        "outcome_events": (lambda s, d: outcome.events(done(s, d)), after["outcome_events"]),
        "outcome_duplicates": (lambda s, d: outcome.duplicates(done(s, d)), after["outcome_duplicates"]),
        "outcome_articles": (lambda s, d: outcome.articles(done(s, d), at()).drop("quality_reasons", "headings", "crawled_at"), after["outcome_articles"]),
        "crawl_summary": (lambda s, d: outcome.summary(done(s, d)).withColumns({c: F.to_json(c) for c in ("block_reasons", "dupe_breakdown")}), after["crawl_summary"]),
        "link_enqueue": (enqueue, after["link_enqueue"]),
        "discovery_sources": (lambda s, d: _hosts(s, d).select("domain", F.posexplode(discovery.source_list(F.col("domain"))).alias("pos", "source")), sources),
        "seed_queue": (lambda s, d: discovery.seed(_hosts(s, d).withColumn("declared", F.lit(None).cast("array<string>")), _feeds(s, d)), oracles.seed_queue()),
        "classify_page": (lambda s, d: page(s, d).select("page_id", html.classify_page(F.col("html"), F.col("url")).alias("c")).select("page_id", "c.page_type", "c.reason"), oracles.classify()),
        "content_type": (lambda s, d: page(s, d).select("page_id", html.content_type(F.col("url"), F.lit(None).cast("string")).alias("content_type")), r"""SELECT page_id, CASE WHEN regexp_matches(p, '/wiki/|^/wiki') THEN 'wiki' WHEN regexp_matches(p, '/news/|/article/|noticia|actualite') THEN 'news' WHEN regexp_matches(p, '/blog/|/post/|/posts/') THEN 'blog' ELSE 'article' END AS content_type
          FROM (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)"""),
        "uniqueness": (lambda s, d: docs(s, d).select("doc_id", F.round(text.uniqueness(F.col("text")), 6).alias("uniqueness"), text.sentence_count(F.col("text")).alias("sentences")), uniq),
        "detect_language": (lambda s, d: docs(s, d).select("doc_id", text.detect_language(F.col("text")).alias("language")), detect),
        "block_detect": (lambda s, d: page(s, d).select("page_id", blocks.detect_block(F.lit(200), F.col("html")).alias("b")).select("page_id", "b.blocked", "b.reason"), block),
        "block_detect_legacy": (lambda s, d: page(s, d).select("page_id", blocks.detect_block_legacy(F.lit(200), F.col("html")).alias("b")).select("page_id", "b.blocked", "b.reason"), legacy),
        "html_headings": (lambda s, d: page(s, d).select("page_id", F.array_join(html.headings(F.col("html")), "|").alias("headings"), html.html_lang(F.col("html")).alias("lang")), heads),
        "dedup_warm": (warm, """WITH b AS (SELECT DISTINCT text FROM benchmark), f AS (SELECT text, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text)
          SELECT doc_id AS seq, NOT coalesce(b.text IS NOT NULL OR first < doc_id, false) AS kept, CASE WHEN b.text IS NOT NULL OR first < doc_id THEN 'exact_content' END AS dup_type, CASE WHEN b.text IS NULL AND first < doc_id THEN first END AS duplicate_of
          FROM documents d LEFT JOIN b ON d.text = b.text LEFT JOIN f ON d.text = f.text"""),
        "domain_due": (due, islands + f""", u AS (SELECT domain, CASE WHEN consecutive_failures >= 1 THEN CAST(floor(epoch(last)) AS BIGINT) + 86400 END AS until, CAST(floor(epoch(last)) AS BIGINT) AS last_s, CAST(epoch(TIMESTAMP '{now_events}') AS BIGINT) AS now FROM g),
          w AS (SELECT domain, greatest(0.0::DOUBLE, coalesce(CAST(until - now AS DOUBLE), 0), coalesce(1.5::DOUBLE - (now - last_s), 0)) AS wait FROM u)
          SELECT domain, wait, CASE WHEN wait > 10 THEN 'defer' WHEN wait > 0 THEN 'sleep' ELSE 'go' END AS action, CASE WHEN wait > 10 THEN CAST(floor(wait) AS BIGINT) + 1 END AS defer_seconds FROM w"""),
        "recrawl_due": (recrawl, f"""SELECT o_orderkey AS id, 'pending' AS status FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
          AND epoch(o_orderdate::TIMESTAMP) < epoch(TIMESTAMP '{now_text}') - 3600 * CASE o_custkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 48 WHEN 2 THEN 168 ELSE 24 END"""),
        "article_upsert": (upsert, """SELECT 'https://h/' || o_custkey AS url, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS title FROM orders GROUP BY o_custkey"""),
        "stream_counts": (lambda s, d: crawl_log.drain(crawl_log.counts(_log(s, d)), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n"),
          "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, CASE event_type WHEN 'error' THEN 'blocked' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY ALL"),
        "stream_sessions": (lambda s, d: crawl_log.drain(crawl_log.sessions(_log(s, d)), "complete").select("domain", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"),
          """WITH g AS (SELECT user_id AS domain, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new, event_id FROM events),
          r AS (SELECT *, sum(new) OVER (PARTITION BY domain ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT domain, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n FROM r GROUP BY domain, k"""),
        "stream_breaker": (lambda s, d: crawl_log.drain(crawl_log.breaker(_log(s, d), trip=2), "update").groupBy("domain").agg(*(F.max_by(c, "batch").alias(c) for c in ("total_fetched", "total_blocked", "consecutive_failures", "max_run"))),
          islands + " SELECT domain, total_fetched, total_blocked, consecutive_failures, max_run FROM g"),
    }
