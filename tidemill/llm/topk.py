"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates lie in blocks. In a block each dimension is a list sorted by value,
built once; blocks of queries come by, one after the other, and each query reads
every list from the end that its sign favours, all to the same depth, a stretch
at a time. What has been read bounds every candidate's score from below (unread
values replaced by the list's far end) and from above (by the last value read).
Reading ends for a query when so few candidates can still reach its k-th lower
bound that their final scores are resolved at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a block of candidates and of queries, about: bounds a task's memory.
BLOCK, QUERY_BLOCK = 4096, 256
#: Parts of the lists after which bounds are looked at; bounds of dense vectors close late.
DEPTHS = (1 / 8, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 31 / 32)
SINGLE, EXACT = 1 << 24, 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Lists:
    """The sorted lists of a block of candidates, in the order of (id, row)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, c: np.ndarray):
        self.ids, self.rows, self.c = ids, rows, c
        self.order = np.ascontiguousarray(np.argsort(c, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(c, self.order.T, 0).T)

    def resolve(self, q: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of members and their scores; sums are whole numbers that the type holds exactly."""
        score = self.c[members] @ q
        best = np.lexsort((members, -score))[:k]
        return members[best], score[best].astype(np.int64)

    def search(self, q_rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of each query's k best, ties to smaller id, and the depth to which each query read."""
        n, dims = self.c.shape
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.values[:, 0], self.values[:, -1]
        top, bottom = (np.zeros((n, dims), q.dtype) for _ in range(2))
        known = np.zeros((n, len(q)), q.dtype)  # of each score, what has been read
        todo, depth, read, found = np.arange(len(q)), np.full(len(q), n), 0, []
        for part in (*DEPTHS, 1.0):
            upto = min(n, max(read + 1, round(n * part)))
            for d in range(dims) if upto > read else ():
                for side, seen, at in ((up, top, slice(n - upto, n - read)), (down, bottom, slice(read, upto))):
                    if side[todo, d].any():
                        who = self.order[d, at]
                        known[who] += self.values[d, at, None] * side[todo, d]
                        seen[who, d] = 1
            read = upto
            own = self.rows[:, None] == q_rows[todo]
            u, v = up[todo], down[todo]
            floor = known + (u @ low + v @ high) - top @ (u * low).T - bottom @ (v * high).T
            ceiling = known + (u @ self.values[:, n - read] + v @ self.values[:, read - 1]) - top @ (u * self.values[:, n - read]).T - bottom @ (v * self.values[:, read - 1]).T
            floor[own] = ceiling[own] = -np.inf
            kth = np.partition(floor, max(n - k, 0), axis=0)[max(n - k, 0)]
            can = (ceiling >= kth) & ~own
            done = (can.sum(0) <= max(4 * k, 64)) | (read == n)
            for i in np.flatnonzero(done):
                best, score = self.resolve(q[todo[i]], np.flatnonzero(can[:, i]), k)
                found.append((np.full(len(best), todo[i]), best, score))
            depth[todo[done]] = read
            todo, known = todo[~done], np.ascontiguousarray(known[:, ~done])
            if not len(todo):
                break
        none = np.zeros(0, np.int64)
        return (*(np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ([], [], []))), depth)


def _whole(x: float) -> int:
    return math.floor(256 * x) if abs(x) < 2.0**900 else int(x) * 256


def search_wide(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As Lists.search for products that doubles can't hold: whole numbers of any size, lists read to their ends."""
    rows, cols, score = [], [], []
    for i, x in enumerate(q):
        sums = sorted((-min(max(sum(map(int.__mul__, x, y)), LEAST), MOST), j) for j, y in enumerate(c) if c_rows[j] != q_rows[i])[:k]
        rows += [i] * len(sums)
        cols += [j for _, j in sums]
        score += [-s for s, _ in sums]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(score, np.int64)


def _pack(rows: pa.Table) -> pa.Table:
    """One row per (block, dims): row numbers, ids and vectors of its rows as bytes, in the order of (id, row)."""
    dims = rows.column("dims")[0].as_py()
    ids, row = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
    values = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), max(dims, 0))
    order = np.lexsort((row, ids))
    return pa.table({
        "block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "dims": pa.array([dims], pa.int32()),
        **{n: pa.array([a[order].tobytes()], pa.binary()) for n, a in (("rows", row), ("ids", ids), ("vecs", values))},
    })


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, query_step: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by query_step, the k rows of highest inner product.

    Components become floor(256 * x). Rows with a null id, a null vector, or
    null or non-finite components take no part; vectors only meet vectors of
    their own length; empty vectors score 0. Every row but the query's own is a
    candidate: repeated rows are candidates and queries each of their own.
    Fewer than k candidates: all. Ties go to the smaller id. Other columns
    aren't looked at. Scores beyond 64 bits are the nearest number that they hold.
    """
    finite = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dims"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "vectors")
    n = rows.count()
    blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-n // (query_step * QUERY_BLOCK)))
    spread = lambda b: F.pmod(F.xxhash64("row"), F.lit(b))
    shape = "block long, dims int, rows binary, ids binary, vecs binary"
    pack = lambda df, b: df.withColumn("block", spread(b)).groupBy("dims", "block").applyInArrow(_pack, shape)
    cand = pack(rows, blocks).select("dims", "block", F.lit(-1).cast("long").alias("q_block"), "rows", "ids", "vecs")
    # Candidates stay where they are; each block of queries goes to every block of candidates.
    ask = pack(rows.where(F.col("vec_id") % query_step == 0), q_blocks).withColumnRenamed("block", "q_block")
    ask = ask.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "q_block", "rows", "ids", "vecs")
    met = cand.unionByName(ask).repartition(blocks, "dims", "block").sortWithinPartitions("dims", "block", "q_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                row, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["vecs"], np.float64).reshape(len(row), max(r["dims"], 0))
                if r["q_block"] < 0:
                    place, held, lists = (r["dims"], r["block"]), (ids, row, x), {}
                    continue
                if place != (r["dims"], r["block"]):
                    continue  # no vector of this length is in this block
                c_ids, c_row, c = held
                most = 256 * max(float(np.abs(a).max(initial=0)) for a in (x, c)) + 1
                bound = 4 * most * most * max(r["dims"], 1)  # of the sums that bounds are made of
                if bound >= EXACT:
                    if "wide" not in lists:
                        lists["wide"] = [list(map(_whole, v)) for v in c.tolist()]
                    i, j, s = search_wide(row, [list(map(_whole, v)) for v in x.tolist()], c_row, lists["wide"], k)
                else:
                    kind = np.float32 if bound < SINGLE else np.float64
                    if kind not in lists:
                        lists[kind] = Lists(c_ids, c_row, np.floor(256 * c).astype(kind) if r["dims"] > 0 else np.zeros((len(c), 1), kind))
                    i, j, s, _ = lists[kind].search(row, np.floor(256 * x).astype(kind) if r["dims"] > 0 else np.zeros((len(x), 1), kind), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(row[i]), pa.array(c_ids[j]), pa.array(c_row[j]), pa.array(s)], ["query_id", "q_row", "vec_id", "c_row", "score"])

    best = met.mapInArrow(run, "query_id long, q_row long, vec_id long, c_row long, score long")
    w = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
