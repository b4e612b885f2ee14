"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most d bits, cut into fewer than d + 1 segments,
have a segment that differs in one bit at most. Each segment is indexed once
for each of its bits with that bit left out; equal variants are candidates,
whose whole fingerprints are then compared. Only distinct fingerprints are
indexed, so exact copies cost nothing, and from candidates that share a variant
only as many links come as join them up, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import discard, materialize, row_key, sieve, sift, text_key

#: Candidates that share a variant are compared pair by pair up to so many, and by growing trees beyond.
SMALL_RUN = 8
_CHUNK = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """words to a shingle; 64-bit words of a fingerprint; segments and their bits; differing bits that link."""

    shingle: int = 3
    width: int = 1
    segments: int = 2
    segment_bits: int = 32
    distance: int = 3

    def __post_init__(self):
        if 2 * self.segments <= self.distance:
            raise ValueError("too few segments: pairs with two differing bits in each would be missed")


#: Two segments of 32 bits find every pair that differs in 3 bits or fewer.
BITS_3 = Scheme()
#: Five-word shingles and a Jaccard similarity of 0.8. Fingerprints within BITS_3 are candidates first. They can't promise
#: 0.8: such a pair differs in 19 +/- 4 of 128 bits, and with segments enough to find them all each segment would have
#: about 8 bits, which chance pairs share too. MinHash bands name what they leave.
SIMILAR_08 = neardup.Similar()


def fingerprint(text: str | None, scheme: Scheme = BITS_3) -> np.ndarray:
    """scheme.width 64-bit words; a bit is 1 if it is set in over half of the shingles' hashes. No words: zero."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(scheme.width, np.uint64)
    k = min(scheme.shingle, len(words))
    joined, n = b" ".join(words), len(words) - k + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[k - 1 :].tolist()
    digest, out = xxhash.xxh64_intdigest, []
    for seed in range(42, 42 + scheme.width):
        counts = np.zeros(64, np.int64)
        for s in range(0, n, _CHUNK):
            a, b = starts[s : s + _CHUNK], ends[s : s + _CHUNK]
            h = np.fromiter([digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)], np.uint64, len(a))
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, scheme: Scheme, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, f0, f1...) of each row, h being the text's hash."""
    bare = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    names = [f"f{i}" for i in range(scheme.width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), scheme) for t in batch.column(2)]
            cols = np.stack(fps).view(np.int64) if fps else np.zeros((0, scheme.width), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(scheme.width))], ["doc_id", "h", *names])

    return bare.mapInArrow(run, f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, h long, " + ", ".join(f"{n} long" for n in names))


def _variants(scheme: Scheme) -> Column:
    """Keys of all one-wildcard variants: number of segment and wildcard, then the segment without that bit."""
    w, mask, out = scheme.segment_bits, (1 << scheme.segment_bits) - 1, []
    for s in range(scheme.segments):
        word, off = divmod(s * w, 64)
        value = F.shiftrightunsigned(f"f{word}", off)
        if off + w > 64:
            value = value.bitwiseOR(F.shiftleft(f"f{word + 1}", 64 - off))
        for b in range(w):
            out.append(value.bitwiseAND(F.lit(mask & ~(1 << b)).cast("long")).bitwiseOR(F.lit((s * w + b) << 33).cast("long")))
    return F.array(*out)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _place(key: int, scheme: Scheme) -> tuple[int, int, bool]:
    """Word and bit that a key leaves out, and whether it is its segment's first: only there need links within halves be looked for."""
    bit = int(key) >> 33
    return bit // 64, bit % 64, bit % scheme.segment_bits == 0


def tree(fps: np.ndarray, half: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Joins up what is within `distance`, each connected part as a star about its first row; with half, only links between its two values count."""
    left, out = np.arange(len(fps)), []
    while len(left):
        root, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _distance(fps[left], fps[x]) <= distance
            if half is not None:
                near &= half[left] != half[x]
            got = left[near]
            out += [(root, int(y)) for y in got]
            queue += got.tolist()
            left = left[~near]
    return out


def links_of_runs(keys: np.ndarray, fps: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that join up all linked rows with equal keys; keys are sorted."""
    a, b = [], []
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    long = np.flatnonzero(ends - starts > SMALL_RUN)
    small = np.ones(len(keys), bool)
    for r in long:
        s, e = starts[r], ends[r]
        small[s:e] = False
        word, bit, first = _place(keys[s], scheme)
        half = None if first else (fps[s:e, word] >> np.uint64(bit)) & np.uint64(1)
        if half is not None and (half == half[0]).all():
            continue
        # In the order of the fingerprints, so that the stars of many runs share their centres.
        order = np.lexsort(fps[s:e].T)
        star = np.array(tree(fps[s:e][order], None if half is None else half[order], scheme.distance), np.int64).reshape(-1, 2)
        a.append(s + order[star[:, 0]])
        b.append(s + order[star[:, 1]])
    at = np.flatnonzero(small)
    k, f = keys[at], fps[at]
    step = 1
    i = np.arange(len(k))
    while True:
        i = i[i + step < len(k)]
        i = i[k[i] == k[i + step]]
        if not len(i):
            break
        bit = k[i] >> 33
        differs = ((f[i, bit // 64] ^ f[i + step, bit // 64]) >> (bit % 64).astype(np.uint64)) & np.uint64(1)
        near = (differs.astype(bool) | (bit % scheme.segment_bits == 0)) & (_distance(f[i], f[i + step]) <= scheme.distance)
        a.append(at[i[near]])
        b.append(at[i[near] + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _hexed(rows: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in r) for r in rows]


def _as_hex(scheme: Scheme) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f"f{i}")), 16, "0") for i in range(scheme.width)))


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): pairs of fingerprints, as hex, that join up all fingerprints within scheme.distance."""
    names = [f"f{i}" for i in range(scheme.width)]
    keyed = nodes.select(F.explode(_variants(scheme)).alias("key"), *names)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros((0, scheme.width), np.uint64)

        def made(k, f):
            i, j = links_of_runs(k, f, scheme)
            return pa.RecordBatch.from_arrays([pa.array(_hexed(f[i]), pa.string()), pa.array(_hexed(f[j]), pa.string())], ["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, np.stack([batch.column(c + 1).to_numpy().view(np.uint64) for c in range(scheme.width)], axis=1)])
            if not len(k):
                continue
            whole = np.searchsorted(k, k[-1])  # the last run may go on in the next batch
            rest_k, rest_f = k[whole:], f[whole:]
            if whole:
                yield made(k[:whole], f[:whole])
        if len(rest_k):
            yield made(rest_k, rest_f)

    return keyed.mapInArrow(run, "a string, b string").distinct()


def candidates(nodes: DataFrame, scheme: Scheme = BITS_3) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, f0, f1...) that join up all whose fingerprints are within scheme.distance.

    Nodes of one fingerprint are tied to the smallest of them, and these to each other.
    """
    names = [f"f{i}" for i in range(scheme.width)]
    own = nodes.select("node", _as_hex(scheme).alias("fp"), *names)
    low = materialize(own.groupBy("fp", *names).agg(F.min("node").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    pairs = own.join(low.where("n > 1").select("fp", "low"), "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    far = links(low, scheme)
    for side in "ab":
        far = far.join(low.select(F.col("fp").alias(side), F.col("low").alias(f"node_{side}")), side)
    return pairs.union(far.select(F.least("node_a", "node_b"), F.greatest("node_a", "node_b")))


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """(node, label, old): each label replaced by its own label in step (node, label), where it has one."""
    step = step.select(F.col("node").alias("s_node"), F.col("label").alias("s_label"))
    return labels.join(step, labels["label"] == step["s_node"], "left").select("node", F.coalesce("s_label", "label").alias("label"), F.col("label").alias("old"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable.

    Each node points to its smallest neighbour, or itself; following the
    pointers doubles their reach until they end in roots. Links are then drawn
    between roots, most of them vanishing, and the rest goes round again.
    """
    pairs = materialize(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct(), "links")
    total = None
    while True:
        both = pairs.union(pairs.select("dst", "src"))
        roots = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")), "pointers")
        while True:
            further = materialize(_follow(roots, roots), "pointers")
            discard(roots)
            if further.where("label <> old").isEmpty():
                break
            roots = further
        roots = further.select("node", "label")
        before, total = total, further if total is None else materialize(_follow(total, roots).select("node", "label"), "labels")
        near = pairs.join(roots, pairs["src"] == roots["node"]).select(F.col("label").alias("new_src"), "dst")
        left = near.join(roots, near["dst"] == roots["node"]).select(F.col("new_src").alias("src"), F.col("label").alias("dst")).where("src <> dst").distinct()
        left = materialize(left, "links")
        discard(pairs, before, None if total is further else further)
        pairs = left
        if pairs.isEmpty():
            discard(pairs)
            return total


def groups(docs: DataFrame, scheme: Scheme = BITS_3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, h (text hash), fingerprint (hex), component_id (smallest doc_id reachable).

    Null and empty texts have the fingerprint zero and are linked like any
    other. A null doc_id is reached like any but is never the smallest; a
    group of nothing else has a null component_id. Repeated rows give repeated
    rows; other columns are not looked at.
    """
    names = [f"f{i}" for i in range(scheme.width)]
    prints = materialize(fingerprints(docs, scheme, id_col=id_col, text_col=text_col), "fingerprints")
    as_hex = _as_hex(scheme)
    nodes = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(links(nodes, scheme))
    named = nodes.select(as_hex.alias("fp"), "rep")
    linked = named.join(found, named["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    linked = materialize(linked, "labelled")
    low = linked.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    low = materialize(low.where("n > 1").select(F.col("label").alias("c_label"), "component_id"), "low")
    member = linked.join(low, linked["label"] == low["c_label"], "left").select(F.col("fp").alias("m_fp"), F.when(F.col("c_label").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    member = materialize(member, "members")
    discard(nodes, found, linked, low)
    own = prints.select("doc_id", "h", as_hex.alias("fingerprint"))
    return own.join(member, own["fingerprint"] == member["m_fp"]).select("doc_id", "h", "fingerprint", "component_id")


def dedup(docs: DataFrame, scheme: Scheme | neardup.Similar = SIMILAR_08, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of smallest id of each group (null ids last, then by text hash), all columns kept."""
    if isinstance(scheme, neardup.Similar):
        member = neardup.groups(docs, scheme, candidates, components, id_col=id_col, text_col=text_col)
    else:
        member = groups(docs, scheme, id_col=id_col, text_col=text_col)
    member = materialize(member, "groups")
    # Rows without any id to their group are told apart by their fingerprint.
    own = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    several = member.groupBy("component_id", own.alias("own")).agg(F.count("*").alias("of"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")).where("of > 1")
    several = materialize(several.select(F.col("component_id").alias("g_id"), F.col("own").alias("g_own"), "first"), "groups-of-several")
    grouped = member.withColumn("own", own).join(several, F.col("component_id").eqNullSafe(F.col("g_id")) & F.col("own").eqNullSafe(F.col("g_own")))
    stays = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("h") == F.col("first.h"))
    grouped = materialize(grouped.select("doc_id", "h", row_key("doc_id", "h").alias("key"), stays.alias("stays")), "grouped")
    # Only rows of groups of several are moved; the others stay where they are. Of equal rows the group keeps one.
    held = materialize(sieve(grouped), "sieve")
    discard(member, several)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_h"))
    keyed = keyed.withColumn("key", row_key("id", "text_h"))
    alone = sift(keyed, held, at_all=False).select("row.*")
    verdicts = grouped.groupBy("key", "doc_id", "h").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).withColumnRenamed("key", "g_key")
    met = sift(keyed, held, at_all=True).join(verdicts, (F.col("key") == F.col("g_key")) & F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_h") == F.col("h")), "left")
    once = met.where(F.col("g_key").isNull() | (F.col("stays") & (F.col("n") == 1))).select("row.*")
    again = met.where(F.col("stays") & (F.col("n") > 1)).dropDuplicates(["g_key", "doc_id", "h"]).select("row.*")
    return alone.unionByName(once).unionByName(again)
