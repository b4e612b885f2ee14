"""Sinks of a crawl: articles as JSON lines, the run's counters as one JSON file, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def json_lines(articles: DataFrame, path: str) -> None:
    """Replaces what is at path; nulls are written, so every line has every field."""
    articles.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def stats(summary: DataFrame, path: str) -> None:
    """A summary is one row; it goes to one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds events or duplicates to a Parquet log."""
    rows.write.mode("append").parquet(path)
