"""Registered queries of the crawl operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import dedup, frontier
from . import monitoring, oracles, runs

AS_OF = "2024-02-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a crawl log: users stand for domains, errors for blocks."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'fetch_started' WHEN 'view' THEN 'fetch_failed' ELSE 'enqueued' END")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("domain"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("reason"), F.col("value"))


EVENTS = """e AS (SELECT event_id AS id, ts, user_id AS domain, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'blocked'
  WHEN 'click' THEN 'fetch_started' WHEN 'view' THEN 'fetch_failed' ELSE 'enqueued' END AS kind, json_extract_string(props, '$.k') AS reason, value FROM events)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table read as a crawl queue."""
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'in_progress' ELSE 'done' END")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://h/"), F.col("o_custkey").cast("string")).alias("url"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderkey").alias("article_id"), F.lit("before").alias("last_error"),
    )


QUEUE = """q AS (SELECT o_orderkey AS id, 'https://h/' || o_custkey AS url, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'in_progress' ELSE 'done' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_orderkey % 4 AS INTEGER) AS attempts, 3 AS max_attempts, o_orderdate AS next_attempt_at, o_orderdate AS updated_at, CAST(epoch(o_orderdate) AS BIGINT) AS was FROM orders)"""
NOW = "1998-01-01 00:00:00"


def build() -> dict:
    """name -> (query, SQL or None)."""
    read = _read
    at, now = (lambda t=t: F.lit(t).cast("timestamp") for t in (AS_OF, NOW))  # columns need a session, so only when asked for
    page = lambda s, d: read(s, d, "pages")
    docs = lambda s, d: read(s, d, "documents")
    out: dict = {}
    classify, norm = oracles.classify(), oracles.normalize()
    out["url_classify"] = (lambda s, d: page(s, d).select("page_id", urls.classify_url(F.col("url")).alias("c")).select("page_id", "c.page_type", "c.reason"), classify)
    out["url_normalize"] = (lambda s, d: page(s, d).select("page_id", urls.normalize_url(F.col("url")).alias("url_key")), norm)
    out["url_dedup"] = (lambda s, d: page(s, d).groupBy(urls.normalize_url(F.col("url")).alias("url_key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")), f"SELECT url_key, min(page_id) AS first_page, count(*) AS n FROM ({norm}) GROUP BY url_key")
    out["url_trap"] = (lambda s, d: page(s, d).select("page_id", urls.is_trap(F.col("url")).alias("trap"), urls.is_sitemap(F.col("url")).alias("sitemap"), urls.sitemap_priority(F.col("url")).alias("priority")),
        f"WITH {oracles.url_parts()} SELECT page_id, length(path) - length(replace(path, '/', '')) > 8 OR length(query) - length(replace(query, '&', '')) >= 3 AS trap, contains(lower(path), 'sitemap') AS sitemap, CASE WHEN regexp_matches(lower(url), '/feed|/rss|atom|rss2') THEN 0 WHEN contains(lower(url), 'news') AND contains(lower(url), 'sitemap') THEN 1 WHEN contains(lower(url), 'sitemap_index') OR regexp_matches(lower(url), '/sitemap[.]xml/*$') THEN 3 ELSE 2 END AS priority FROM p")
    out["extract_body"] = (lambda s, d: page(s, d).select("page_id", html.body_text(F.col("html")).alias("main_text")), oracles.body())
    out["page_links"] = (lambda s, d: page(s, d).select("page_id", F.posexplode(html.links(F.col("html"), F.col("url"))).alias("pos", "link")), oracles.PAGE_LINKS)
    # Pages without a body give no row; the array is told apart from its filter, so the article is worked out once.
    article = lambda: F.filter(F.array(html.extract(F.col("html"), F.col("url"), at())), lambda a: a["main_text"].isNotNull())
    out["article_extract"] = (lambda s, d: page(s, d).select("page_id", F.inline(article())).drop("headings", "quality_reasons"), f"SELECT * FROM ({oracles.extracted()}) WHERE main_text IS NOT NULL")
    out["mon_content_type"] = (lambda s, d: monitoring.content_types(page(s, d).select(html.content_type(F.col("url"), F.lit(None).cast("string")).alias("content_type"))), f"SELECT {oracles.CONTENT_TYPE} AS content_type, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages) GROUP BY 1")
    out["exact_fingerprint"] = (lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")
    chunks = "SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(substr(text, 1, 20000), i * 4500 + 1, 4500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(least(length(text), 20000) / 4500.0) AS BIGINT))) AS i FROM documents WHERE coalesce(lang, '') <> 'en' AND length(text) > 0)"
    out["translate_chunks"] = (lambda s, d: docs(s, d).select("doc_id", F.posexplode(text.translate_chunks(F.col("text"), F.col("lang"))).alias("pos", "chunk")), chunks)

    def full(s, d):
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
        rows = docs(s, d).select(F.col("doc_id").alias("seq"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), "text", F.substring_index("text", "\n", 1).alias("title"), day.alias("publish_date"))
        return dedup.layered(rows)

    out["dedup_full"] = (full, oracles.dedup_full())
    bands = lambda s, d: docs(s, d).select(F.col("doc_id").alias("seq"), dedup.minhash_bands("text").alias("bands"))
    out["dedup_near"] = (lambda s, d: bands(s, d).select("seq", F.posexplode("bands").alias("band", "key")).groupBy("band", "key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").groupBy("band", "first", "n").agg(F.count("*").alias("runs")),
        f"WITH RECURSIVE {oracles.dedup_steps('SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS url_key, text, NULL::VARCHAR AS td FROM documents')}, g AS (SELECT CAST(band AS INTEGER) AS band, key, min(seq) AS first, count(*) AS n FROM band GROUP BY band, key HAVING count(*) > 1) SELECT band, first, n, count(*) AS runs FROM g GROUP BY ALL")
    out["dedup_exact"] = (lambda s, d: docs(s, d).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
    stats = lambda s, d: docs(s, d).select(F.concat(F.lit("https://x/"), (F.col("doc_id") % 100).cast("string")).alias("url"), "text", F.substring("text", 1, 12).alias("title"), F.lit("2024-01-01").alias("publish_date"))
    out["dedup_statistics"] = (lambda s, d: dedup.statistics(stats(s, d)), f"SELECT count(DISTINCT doc_id % 100) AS unique_urls, count(DISTINCT sha256(text)) AS unique_content_hashes, count(DISTINCT {oracles.NORM_TITLE}) AS unique_title_dates, count(text) AS lsh_index_size FROM (SELECT *, substr(text, 1, 12) AS title FROM documents)")

    def dated(s, d):
        day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
        form, as_text = F.col("doc_id") % 6, lambda f: F.date_format(day, f)
        week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), (F.weekday(day) + 1).cast("string"))
        return docs(s, d).select("doc_id", "text", F.when(form == 0, as_text("yyyy-MM-dd")).when(form == 1, as_text("yyyy/M/d")).when(form == 2, as_text("yyyyMMdd")).when(form == 3, F.concat(as_text("yyyy-MM-dd"), F.lit("T23:59:59Z"))).when(form == 4, week).otherwise("soon").alias("date"))

    day = "DATE '2023-01-01' + CAST(doc_id % 500 AS INTEGER)"
    as_dates = f"SELECT doc_id, text, CASE WHEN doc_id % 6 < 5 THEN CAST({day} AS TIMESTAMP) + CASE WHEN doc_id % 6 = 3 THEN INTERVAL 86399 SECOND ELSE INTERVAL 0 SECOND END END AS ts, CASE doc_id % 6 WHEN 5 THEN 'soon' ELSE 'x' END AS date FROM documents"
    age = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400)"
    fresh = f"CASE WHEN ts IS NULL THEN 0.0::DOUBLE WHEN {age} <= 7 THEN 1 WHEN {age} >= 365 THEN 0 ELSE 1 - ({age} - 7) / 358::DOUBLE END"
    out["freshness"] = (lambda s, d: dated(s, d).select("doc_id", F.unix_timestamp(text.parse_date(F.col("date"))).alias("parsed"), F.round(text.freshness(F.col("date"), at()), 6).alias("freshness")), f"SELECT doc_id, CAST(epoch(ts) AS BIGINT) AS parsed, round({fresh}, 6) AS freshness FROM ({as_dates})")
    scored = f"SELECT doc_id, coalesce(text, '') AS body, 'A title' AS title, NULL AS author, date, 1 AS n_headings, 'en' AS language, {fresh} AS fresh FROM ({as_dates})"
    out["quality_score"] = (lambda s, d: dated(s, d).select("doc_id", text.quality(F.col("text"), F.lit("A title"), F.lit(None).cast("string"), F.col("date"), F.array(F.lit("A title")), F.lit("en"), at())["score"].alias("score")), f"SELECT doc_id, score FROM ({oracles.score_parts(scored)})")
    out["repair"] = (lambda s, d: docs(s, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "cafÃ© ").otherwise(""), F.when(F.col("doc_id") % 2 == 1, "“").otherwise(""), F.regexp_replace("text", r"[^\x20-\x7E]", ""), F.when(F.col("doc_id") % 2 == 1, "”").otherwise("")).alias("t")).select("doc_id", text.repair(F.col("t")).alias("fixed")),
        r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'café ' || t ELSE '"' || t || '"' END AS fixed FROM (SELECT doc_id, regexp_replace(text, '[^\x20-\x7E]', '', 'g') AS t FROM documents)""")  # fmt: skip
    out["claim_pending"] = (lambda s, d: frontier.claim(_queue(s, d), now()).select("id", "status"), f"WITH {QUEUE} SELECT id, 'in_progress' AS status FROM q WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '{NOW}' ORDER BY priority DESC, next_attempt_at, id LIMIT 20")
    seen = lambda: F.unix_timestamp("updated_at").alias("updated_s")
    now_s = f"CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT)"
    stale = f"status = 'in_progress' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE"
    out["reclaim_stale"] = (lambda s, d: frontier.reclaim(_queue(s, d), now()).select("id", "status", seen()), f"WITH {QUEUE} SELECT id, CASE WHEN {stale} THEN 'pending' ELSE status END AS status, CASE WHEN {stale} THEN {now_s} ELSE was END AS updated_s FROM q")
    out["reclaim_count"] = (lambda s, d: frontier.changed(_queue(s, d), frontier.is_stale(now())), f"WITH {QUEUE} SELECT count(*) AS changed FROM q WHERE {stale}")
    out["release"] = (lambda s, d: frontier.release(_queue(s, d), now()).select("id", "status", seen()), f"WITH {QUEUE} SELECT id, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'in_progress' THEN {now_s} ELSE was END AS updated_s FROM q")
    out["retry_schedule"] = (lambda s, d: frontier.fail(_queue(s, d), now(), F.lit("timeout")).select("id", "status", "attempts", "last_error", F.unix_timestamp("next_attempt_at").alias("next_s"), seen()), f"WITH {QUEUE} SELECT id, CASE WHEN attempts + 1 >= max_attempts THEN 'failed' ELSE 'pending' END AS status, attempts + 1 AS attempts, 'timeout' AS last_error, {now_s} + 30 * (1 << attempts) AS next_s, {now_s} AS updated_s FROM q")
    out["defer"] = (lambda s, d: frontier.defer(_queue(s, d), now(), 60).select("id", "status", "attempts", "last_error", F.unix_timestamp("next_attempt_at").alias("next_s"), seen()), f"WITH {QUEUE} SELECT id, 'pending' AS status, attempts, 'before' AS last_error, {now_s} + 60 AS next_s, {now_s} AS updated_s FROM q")
    islands = f"""WITH {EVENTS}, i AS (SELECT *, kind = 'blocked' AS blocked, sum(CASE WHEN kind = 'blocked' THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM e),
      r AS (SELECT domain, island, sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS run, count(*) AS n FROM i GROUP BY ALL)
      SELECT domain, CAST(sum(n) AS BIGINT) AS total_fetched, CAST(sum(run) AS BIGINT) AS total_blocked, CAST(max_by(run, island) AS BIGINT) AS consecutive_failures, CAST(max(run) AS BIGINT) AS max_run, max(run) >= 2 AS ever_tripped FROM r GROUP BY domain"""
    out["domain_breaker"] = (lambda s, d: frontier.breaker(_events(s, d).select("domain", "ts", "id", (F.col("kind") == "blocked").alias("blocked")), trip=2).select("domain", "total_fetched", "total_blocked", "consecutive_failures", "max_run", "ever_tripped"), islands)
    depth = "SELECT status, count(*) AS n FROM q GROUP BY status"
    out["mon_queue_depth"] = (lambda s, d: _queue(s, d).groupBy("status").agg(F.count("*").alias("n")), f"WITH {QUEUE} {depth}")
    out["mon_lang"] = (lambda s, d: docs(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("avg_chars")), "SELECT lang, count(*) AS n, round(avg(n_chars), 3) AS avg_chars FROM documents GROUP BY lang")
    out |= monitoring.build(_events, _queue, EVENTS, QUEUE) | runs.build(_events, _queue, at, now, EVENTS, QUEUE, AS_OF, NOW)
    return out


def queries() -> dict:
    return {k: q for k, (q, _) in build().items()}


def oracle_sql() -> dict:
    return {k: o for k, (_, o) in build().items() if o}
