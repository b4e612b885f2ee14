"""The crawl log as a stream: windowed counts, sessions, late-safe dedup and the domain breaker as state.

Every function takes and returns a streaming (or batch) DataFrame with the
columns ts (timestamp), id, domain, kind; `drain` runs one to the end of what
there is, which is also how a scheduled job would run it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..tables import scratch


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream, its schema taken from what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # A stream reads folders: the file's own, and of that this file alone.
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def counts(log: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by window and kind, tumbling or sliding; rows later than `late` are left out by the watermark."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return log.withWatermark("ts", late).groupBy(span.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of activity of a domain without a pause of `gap`."""
    out = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "domain").agg(F.count("*").alias("n"))
    return out.select("domain", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered within `late`."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def breaker(log: DataFrame, trip: int = 4, pause: int = 300) -> DataFrame:
    """State of each domain after each batch: total_fetched, total_blocked, consecutive_failures, max_run, last_fetch_at, blocked_until.

    Takes rows in the order of (ts, id) within a batch. A domain's state is five
    numbers; its rows of a batch pass through in Arrow batches. For a history,
    operators.frontier.breaker gives the same fold.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched, bad, run, most, last = state.get if state.exists else (0, 0, 0, 0, 0)
        # Rows of a group arrive in any order; three narrow columns are all that is sorted.
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["us", "id"])
        for us, blocked in zip(rows["us"], rows["blocked"], strict=True):
            fetched, bad, run, last = fetched + 1, bad + int(blocked), run + 1 if blocked else 0, max(last, int(us))
            most = max(most, run)
        state.update((fetched, bad, run, most, last))
        until = last + pause * 1_000_000 if run >= trip else None
        yield pd.DataFrame({"domain": [key[0]], "total_fetched": [fetched], "total_blocked": [bad], "consecutive_failures": [run], "max_run": [most], "last_us": [last], "until_us": pd.array([until], dtype="Int64")})

    bare = log.select("domain", "id", F.unix_micros("ts").alias("us"), (F.col("kind") == "blocked").alias("blocked"))
    kind = log.schema["domain"].dataType.simpleString()
    out = bare.groupBy("domain").applyInPandasWithState(
        step, f"domain {kind}, total_fetched long, total_blocked long, consecutive_failures long, max_run long, last_us long, until_us long",
        "fetched long, bad long, run long, most long, last long", "update", GroupStateTimeout.NoTimeout,
    )
    return out.select("domain", "total_fetched", "total_blocked", "consecutive_failures", "max_run", F.timestamp_micros("last_us").alias("last_fetch_at"), F.timestamp_micros("until_us").alias("blocked_until"))


def append(log: DataFrame, path: str, checkpoint: str, **trigger) -> object:
    """Appends a stream to a Parquet log, each row exactly once across restarts from the same checkpoint."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all its input, as a table with the number of each row's batch.

    In complete mode a batch has everything, so only the last is kept; in
    update mode a row of a later batch replaces the row of its key before.
    """
    spark = stream.sparkSession
    path, point = scratch(spark, "stream-out"), scratch(spark, "stream-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        # Named by the batch, so that one tried again replaces itself.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number:09d}")

    run = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", point).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", IntegerType())).option("recursiveFileLookup", True).parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out
