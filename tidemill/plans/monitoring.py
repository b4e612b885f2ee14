"""Monitoring queries over the crawl log, the articles and the duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def success(events: DataFrame) -> DataFrame:
    kind, n = F.col("kind"), F.count_if
    started, saved = n(kind == "fetch_started"), n(kind == "saved")
    return events.agg(saved.alias("saved"), n(kind.isin("fetch_failed", "blocked", "gave_up")).alias("failures"), started.alias("attempts"), F.round(saved * 100.0 / F.nullif(started, F.lit(0)), 1).alias("success_pct"))


def blocked(events: DataFrame) -> DataFrame:
    """Blocked pages by domain; reasons is a JSON array of the distinct ones, null among them if there is any, last."""
    reasons = F.array_sort(F.collect_set("reason"))
    reasons = F.when(F.count_if(F.col("reason").isNull()) > 0, F.concat(reasons, F.array(F.lit(None).cast("string")))).otherwise(reasons)
    return events.where("kind = 'blocked'").groupBy("domain").agg(F.count("*").alias("blocked_count"), F.to_json(reasons).alias("reasons")).orderBy(F.desc_nulls_first("blocked_count"), "domain")


def duplicates_by_type(dups: DataFrame) -> DataFrame:
    return dups.groupBy("dup_type").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 3).alias("avg_similarity")).orderBy(F.desc_nulls_first("n"), "dup_type")


def quality_by_domain(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_domain").agg(F.count("*").alias("articles"), F.round(F.avg("quality_score"), 3).alias("avg_quality"), F.count_if(F.col("quality_score") > 0.7).alias("high_quality")).orderBy(F.desc_nulls_first("avg_quality"), "source_domain")


def recent_failures(events: DataFrame, as_of: Column, hours: int = 2, limit: int = 50) -> DataFrame:
    """The newest failures of the last hours, ties by id: id, ts, domain, kind, reason."""
    failed = F.col("kind").isin("fetch_failed", "blocked", "gave_up", "error") & (F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return events.where(failed).orderBy(F.desc("ts"), "id").limit(limit).select("id", "ts", "domain", "kind", "reason")


def content_types(articles: DataFrame) -> DataFrame:
    return articles.groupBy("content_type").agg(F.count("*").alias("n"))


def fetch_gaps(events: DataFrame, delay: float = 1.5) -> DataFrame:
    """Seconds since the domain's fetch before, and the wait that a delay would have asked for."""
    from pyspark.sql import Window

    us = F.unix_micros("ts")
    before = F.lag(us).over(Window.partitionBy("domain").orderBy("ts", "id"))
    gap = (us - before) / 1_000_000
    return events.select("id", "domain", F.round(gap, 3).alias("gap"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.lit(delay) - gap, F.lit(0.0))), 3).alias("wait"))


def constraint_violations(queue: DataFrame) -> DataFrame:
    """Rules that the queue must keep, with the number of rows that break each: known status, one row a url, attempts in bounds."""
    known = F.col("status").isin("pending", "in_progress", "done", "failed", "skipped", "blocked")
    per = queue.groupBy("url").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(known, F.lit(False))).alias("s"), F.count_if(F.col("attempts") > F.col("max_attempts")).alias("a"))
    one = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("unknown_status"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_url"), F.coalesce(F.sum("a"), F.lit(0)).alias("too_many_attempts"))
    return one


def build(events, queue, events_sql: str, queue_sql: str) -> dict:
    """name -> (query, SQL); events and queue read the driver's tables as a crawl log and a queue."""
    docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
    dups = lambda s, d: docs(s, d).select(F.when(F.col("doc_id") % 3 == 0, "url").when(F.col("doc_id") % 3 == 1, "exact_content").otherwise("near_content").alias("dup_type"), F.when(F.col("doc_id") % 3 == 2, (F.col("doc_id") % 100) / 100).alias("similarity"))
    arts = lambda s, d: events(s, d).where("kind = 'saved'").select(F.col("domain").alias("source_domain"), (F.col("value") / 100).alias("quality_score"))
    return {
        "mon_success_rate": (lambda s, d: success(events(s, d)), f"""WITH {events_sql} SELECT count(*) FILTER (WHERE kind = 'saved') AS saved, count(*) FILTER (WHERE kind IN ('fetch_failed', 'blocked', 'gave_up')) AS failures,
            count(*) FILTER (WHERE kind = 'fetch_started') AS attempts, round(100.0::DOUBLE * count(*) FILTER (WHERE kind = 'saved') / nullif(count(*) FILTER (WHERE kind = 'fetch_started'), 0), 1) AS success_pct FROM e"""),
        "mon_blocked_reasons": (lambda s, d: blocked(events(s, d)), f"""WITH {events_sql}, g AS (SELECT domain, count(*) AS blocked_count, list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)) AS r, count(*) FILTER (WHERE reason IS NULL) AS no FROM e WHERE kind = 'blocked' GROUP BY domain)
            SELECT domain, blocked_count, '[' || array_to_string(list_concat(list_transform(coalesce(r, []), lambda x: '"' || x || '"'), CASE WHEN no > 0 THEN ['null'] ELSE [] END), ',') || ']' AS reasons FROM g"""),
        "mon_recent_failures": (lambda s, d: recent_failures(events(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp"), 24).select("id", F.unix_micros("ts").alias("us"), "domain", "kind", "reason"), f"WITH {events_sql} SELECT id, epoch_us(ts) AS us, domain, kind, reason FROM e WHERE kind IN ('blocked', 'fetch_failed') AND ts > TIMESTAMP '2024-01-29 12:00:00' ORDER BY ts DESC, id LIMIT 50"),
        "mon_dupes": (lambda s, d: duplicates_by_type(dups(s, d)), """SELECT CASE doc_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'exact_content' ELSE 'near_content' END AS dup_type, count(*) AS n,
            round(avg(CASE WHEN doc_id % 3 = 2 THEN (doc_id % 100) / 100.0::DOUBLE END), 3) AS avg_similarity FROM documents GROUP BY 1"""),
        "mon_quality_domain": (lambda s, d: quality_by_domain(arts(s, d)), f"WITH {events_sql} SELECT domain AS source_domain, count(*) AS articles, round(avg(value / 100), 3) AS avg_quality, count(*) FILTER (WHERE value / 100 > 0.7) AS high_quality FROM e WHERE kind = 'saved' GROUP BY domain"),
        "fetch_gaps": (lambda s, d: fetch_gaps(events(s, d)), f"""WITH {events_sql}, g AS (SELECT id, domain, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, id)) / 1000000::DOUBLE AS gap FROM e)
            SELECT id, domain, round(gap, 3) AS gap, round(greatest(0.0::DOUBLE, coalesce(1.5::DOUBLE - gap, 0)), 3) AS wait FROM g"""),
        "queue_constraints": (lambda s, d: constraint_violations(queue(s, d)), f"""WITH {queue_sql}, p AS (SELECT url, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('pending', 'in_progress', 'done', 'failed', 'skipped', 'blocked')) AS s, count(*) FILTER (WHERE attempts > max_attempts) AS a FROM q GROUP BY url)
            SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS unknown_status, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated_url, CAST(coalesce(sum(a), 0) AS BIGINT) AS too_many_attempts FROM p"""),
    }
