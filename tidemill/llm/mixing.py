"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are put in a shuffled order that only depends on their
content. A document's virtual finish time is the source's words up to and with
it, divided by the source's target. All sources' documents, as often as they
may repeat, are then sorted by finish time over the whole table and taken until
the budget is used up. Both running totals are made in two steps, totals of
small buckets first, so that no task ever holds a whole source or the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents in a bucket of a running total, about.
BUCKET_ROWS = 4096
#: Buckets whose totals are summed together.
SPAN = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources by code point, null last, weigh `weights` in turn and share `share`
    of all sizes; a target stops at `most` times its source's size and the
    excess goes to the others by weight. In order of size by weight, a source
    is full as long as its part of what is left exceeds its bound; the first
    that isn't sets the level for all behind it (levels only fall from there, so
    it is the highest that holds).
    """
    by_name, one = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap, left = F.col("source_size") * F.lit(float(most)), F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_weights", F.sum("weight").over(one))
        .withColumn("budget", F.sum("source_size").over(one) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left)
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(one))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap"))
        .select("source", "source_size", "weight", "target", F.sum("target").over(one).alias("total"))
    )


def _running(df: DataFrame, part: list[str], bucket: str, order: list[str], amount: str, out: str, limit: int | None = None) -> DataFrame:
    """df with `out`: the running total of `amount` in the order of (bucket, *order) within part, its own row counted.

    With a limit, buckets that begin beyond it are left out before any of their
    rows are moved. Totals go up in three steps: of rows, of buckets, of SPAN
    buckets together, so one task orders few numbers however many rows there are.
    """
    names, top = [f"__{c}" for c in (*part, bucket)], [f"__top_{c}" for c in part]
    first = lambda by, of: Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, by, of: F.coalesce(F.sum(c).over(first(by, of)), F.lit(0))
    sums = df.groupBy(*part, bucket).agg(F.sum(amount).alias("__sum")).withColumn("__span", F.floor(F.col(bucket) / SPAN))
    tops = sums.groupBy(*[F.col(c).alias(t) for c, t in zip(part, top, strict=True)], F.col("__span").alias("__top_span")).agg(F.sum("__sum").alias("__top_sum"))
    tops = tops.withColumn("__ahead", before("__top_sum", top, "__top_span"))
    same = F.col("__span") == F.col("__top_span")
    for c, t in zip(part, top, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(t))
    sums = sums.join(tops, same).withColumn("__before", F.col("__ahead") + before("__sum", [*part, "__span"], bucket))
    if limit is not None:
        sums = sums.where(F.col("__before") <= limit)
    sums = materialize(sums.select(*[F.col(c).alias(n) for c, n in zip((*part, bucket), names, strict=True)], "__before"), "bucket-totals")
    cond = F.lit(True)
    for c, n in zip((*part, bucket), names, strict=True):
        cond = cond & df[c].eqNullSafe(sums[n])
    within = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, cond).withColumn(out, F.col("__before") + F.sum(amount).over(within)).drop("__before", *names)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, h (text hash), source, size, source_size, target, taken, copies.

    size counts runs of non-white characters, a null text has 0. copies is how
    often the document is in the mix, at most `most` times; taken is its words
    there. Sources of size 0 have target 0 and give nothing. Equal rows share a
    place in the shuffled order and are told apart by nothing, so any of them
    may be the one taken; all else depends on content only, and reruns agree.
    An empty table gives an empty result; other columns are not looked at.
    """
    text, md5 = F.col(text_col), F.md5
    order = md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), md5(F.coalesce(text, F.lit("")))))
    docs = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(source_col).alias("source"), size_of(text).alias("size"), order.alias("ord")), "sizes")
    n = docs.count()
    part = F.conv(F.substring("ord", 1, 7), 16, 10).cast("long")
    buckets = max(1, n // BUCKET_ROWS)
    docs = docs.withColumn("bucket", F.floor(part * buckets / float(1 << 28)))
    src = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    src = materialize(src.withColumnRenamed("source", "t_source"), "targets")
    flow = _running(docs, ["source"], "bucket", ["ord"], "size", "upto")
    flow = flow.join(src, flow["source"].eqNullSafe(src["t_source"])).drop("t_source", "bucket")
    flow = flow.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", F.when(F.col("target") > 0, (F.col("source_size") * F.col("epoch") + F.col("upto")) / F.col("target")))
    queue = materialize(flow.where(F.col("finish").isNotNull()), "queue")
    slots = max(1, n * most // BUCKET_ROWS)
    queue = queue.withColumn("slot", F.floor(F.col("finish") * slots).cast("long"))
    # All targets are used up soon after finish 1; what would finish long after is never moved.
    most_words = math.floor((src.agg(F.max("total")).first()[0] or 0) + 0.001)
    queue = _running(queue, [], "slot", ["finish", "source", "ord", "epoch"], "size", "all_upto", limit=most_words).where(F.col("all_upto") <= most_words)
    keys = ["doc_id", "h", "source", "size", "ord"]
    both = docs.select(*keys, F.lit(1).alias("rows"), F.lit(0).alias("got")).unionByName(queue.select(*keys, F.lit(0).alias("rows"), F.lit(1).alias("got")))
    per = both.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("got").alias("got"))
    # Equal rows share what their place in the queue got, as evenly as whole copies go.
    per = per.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.floor(F.col("got") / F.col("rows")) + (F.col("i") <= F.col("got") % F.col("rows")).cast("long")
    return per.join(src, per["source"].eqNullSafe(src["t_source"])).select("doc_id", "h", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))
