"""Crawl queue transitions and domain state, each a pure function of a DataFrame and an as_of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import retry_backoff


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new with `inserted`: the first of each url that the queue lacks."""
    w = Window.partitionBy("url").orderBy("id")
    first = new.withColumn("__i", F.row_number().over(w))
    known = queue.select(F.col("url").alias("__url")).distinct()
    return first.join(known, first["url"] == known["__url"], "left").withColumn("inserted", F.col("__url").isNull() & (F.col("__i") == 1)).drop("__url", "__i")


def claim(queue: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """The pending and due rows of highest priority, longest due first, ties by id, as in progress."""
    due = queue.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of))
    return due.orderBy(F.desc("priority"), "next_attempt_at", "id").limit(limit).withColumn("status", F.lit("in_progress")).withColumn("updated_at", as_of)


def is_stale(as_of: Column, minutes: int = 10) -> Column:
    return F.coalesce((F.col("status") == "in_progress") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))


def _pending(queue: DataFrame, rows: Column, as_of: Column) -> DataFrame:
    return queue.withColumns({"status": F.when(rows, "pending").otherwise(F.col("status")), "updated_at": F.when(rows, as_of).otherwise(F.col("updated_at"))})


def reclaim(queue: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    return _pending(queue, is_stale(as_of, minutes), as_of)


def release(queue: DataFrame, as_of: Column) -> DataFrame:
    return _pending(queue, F.coalesce(F.col("status") == "in_progress", F.lit(False)), as_of)


def changed(queue: DataFrame, rows: Column) -> DataFrame:
    """One row: how many rows a transition of `rows` changes."""
    return queue.agg(F.count_if(rows).alias("changed"))


def fail(queue: DataFrame, as_of: Column, error: Column | None = None) -> DataFrame:
    """One more attempt: failed at the maximum, else pending after 30 s doubled for each attempt before; the error replaces the last one."""
    tried = F.col("attempts") + 1
    later = F.timestamp_seconds(F.unix_timestamp(as_of) + retry_backoff(F.col("attempts")))
    return queue.withColumns({
        "status": F.when(tried >= F.col("max_attempts"), "failed").otherwise("pending"), "next_attempt_at": later, "attempts": tried,
        "last_error": F.lit(None).cast("string") if error is None else error, "updated_at": as_of,
    })


def defer(queue: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return queue.withColumns({"status": F.lit("pending"), "next_attempt_at": F.timestamp_seconds(F.unix_timestamp(as_of) + seconds), "updated_at": as_of})


def settle(queue: DataFrame, results: DataFrame, as_of: Column | None = None) -> DataFrame:
    """queue with the status of results (id, status, last_error, article_id); a null error or article leaves what was there."""
    new = results.select(*(F.col(c).alias(f"__{c}") for c in ("id", "status", "last_error", "article_id")))
    out = queue.join(new, queue["id"] == new["__id"], "left").withColumn("status", F.coalesce("__status", "status"))
    if as_of is not None and "updated_at" in queue.columns:
        out = out.withColumn("updated_at", F.when(F.col("__id").isNotNull(), as_of).otherwise(F.col("updated_at")))
    for c in ("last_error", "article_id"):
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*queue.columns)


def recrawl(queue: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Done rows whose article is older than its kind's window (news 6 h, blog 48 h, wiki 168 h, else 24 h), pending again."""
    kind = articles.select(F.col("id").alias("article_id"), "content_type", "crawled_at")
    hours = F.when(F.col("content_type") == "news", 6).when(F.col("content_type") == "blog", 48).when(F.col("content_type") == "wiki", 168).otherwise(24)
    old = F.unix_timestamp("crawled_at") < F.unix_timestamp(as_of) - hours * 3600
    return queue.where("status = 'done'").join(kind, "article_id").where(old).select(*queue.columns).withColumn("status", F.lit("pending")).withColumn("next_attempt_at", as_of)


def upsert(articles: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("id", "source_domain"), key: str = "url", time: str = "crawled_at") -> DataFrame:
    """Latest row of each key; the kept columns stay as first written."""
    every = articles.unionByName(new)
    last = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), F.col(time)).alias("__last"), *(F.min_by(c, time).alias(f"__{c}") for c in keep))
    return last.select(*(F.col(f"__{c}").alias(c) if c in keep else F.col(f"__last.{c}").alias(c) for c in every.columns))


def breaker(events: DataFrame, trip: int = 4, pause: int = 300) -> DataFrame:
    """events (domain, ts, id, blocked) folded to a row per domain.

    consecutive_failures is the length of the last run of blocked rows;
    blocked_until is set if the last row is blocked and its run has come to
    `trip`; max_run and ever_tripped tell of earlier runs.
    """
    # A domain's log is cut into days first, so no task orders a whole domain; a day tells its runs at either end and its longest.
    day = F.to_date("ts")
    w = Window.partitionBy("domain", "day").orderBy("ts", "id")
    marked = events.withColumn("day", day).withColumn("island", F.sum((~F.col("blocked")).cast("int")).over(w))
    runs = marked.groupBy("domain", "day", "island").agg(F.sum(F.col("blocked").cast("long")).alias("run"), F.count("*").alias("n"), F.max("ts").alias("last"))
    days = runs.groupBy("domain", "day").agg(
        F.sum("n").alias("n"), F.sum("run").alias("bad"), F.max_by("run", "island").alias("tail"), F.max(F.when(F.col("island") == 0, F.col("run"))).alias("lead"),
        F.max("run").alias("most"), F.max("last").alias("last"), (F.sum("run") == F.sum("n")).alias("whole"),
    )
    # Days are joined in order: a run goes on where one day ends and the next begins, through days that are one run.
    start = F.struct(F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("most"))
    step = lambda a, d: F.struct(
        F.when(d["whole"], a["tail"] + d["tail"]).otherwise(d["tail"]).alias("tail"),
        F.greatest(a["most"], d["most"], a["tail"] + F.coalesce(d["lead"], F.lit(0).cast("long"))).alias("most"),
    )
    out = days.groupBy("domain").agg(
        F.sum("n").alias("total_fetched"), F.sum("bad").alias("total_blocked"), F.max("last").alias("last_fetch_at"),
        F.array_sort(F.collect_list(F.struct("day", "tail", "lead", "most", "whole"))).alias("days"),
    ).withColumn("f", F.aggregate("days", start, step)).select("domain", "total_fetched", "total_blocked", F.col("f.tail").alias("consecutive_failures"), F.col("f.most").alias("max_run"), "last_fetch_at")
    until = F.when(F.col("consecutive_failures") >= trip, F.timestamp_seconds(F.unix_timestamp("last_fetch_at") + pause))
    return out.withColumn("blocked_until", until).withColumn("ever_tripped", F.col("max_run") >= trip)


def due(state: DataFrame, as_of: Column, delay: float = 1.5) -> DataFrame:
    """state with wait (s) and action: go, sleep up to 10 s, or defer by the whole seconds and one more."""
    now = F.unix_timestamp(as_of)
    wait = F.greatest(F.lit(0.0), F.coalesce(F.unix_timestamp("blocked_until") - now, F.lit(0)).cast("double"), F.coalesce(delay - (now - F.unix_timestamp("last_fetch_at")), F.lit(0.0)))
    action = F.when(F.col("wait") > 10, "defer").when(F.col("wait") > 0, "sleep").otherwise("go")
    return state.withColumn("wait", wait).withColumn("action", action).withColumn("defer_seconds", F.when(F.col("wait") > 10, F.floor("wait").cast("long") + 1))
