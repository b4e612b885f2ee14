"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: A bitmap of keys has 2^SLOTS words, some 16 MB where it is broadcast. With 2 million keys in it 6 % of other keys pass, and when it is full all do: the joins behind it are exact.
SLOTS = 19
_BIT = f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - SLOTS - 6}) & 63 as int))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}/tidemill-shared").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has gone, and its connection with it
            pass

    atexit.register(remove)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and gives the planner a true size."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes what materialize wrote, once all that was made of it is written too."""
    for df in tables:
        if path := getattr(df, "_written", None):
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage now: shuffle files and broadcasts of past queries stay, on all machines, until it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters left; pure ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def row_key(id_: str | Column, text_hash: str | Column) -> Column:
    """A hash of a row's id and text hash, null ids included; equal rows have equal keys."""
    return F.xxhash64(id_, text_hash)


def sieve(keys: DataFrame) -> DataFrame:
    """(slot, bits): a bitmap of the keys (column key), 2^SLOTS words of 64 bits at most however many keys there are."""
    return keys.groupBy(F.shiftrightunsigned("key", 64 - SLOTS).alias("slot")).agg(F.expr(f"bit_or({_BIT})").alias("bits"))


def sift(rows: DataFrame, held: DataFrame, *, at_all: bool) -> DataFrame:
    """The rows whose key the bitmap may hold (at_all), or those whose key it surely doesn't; nothing is shuffled."""
    met = rows.join(F.broadcast(held.withColumnsRenamed({"slot": "__slot", "bits": "__bits"})), F.shiftrightunsigned(rows["key"], 64 - SLOTS) == F.col("__slot"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.expr(_BIT)) != 0, F.lit(False))
    return met.where(hit if at_all else ~hit).drop("__slot", "__bits")


def same_row(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of the named columns, null equal to null."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
