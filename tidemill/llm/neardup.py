"""Near copies by the Jaccard similarity of word shingles, checked exactly.

SimHash fingerprints of the shingle sets, met by their deletion variants, name
the first candidates, and MinHash bands those that differ in more bits. Each
pair is compared on the whole shingle sets before it becomes a link. Only
distinct sets are compared, and by bands only what the fingerprints' links
leave apart. Sets
that share a band are first compared with the one among them that shares most
bands, and pairs that verified links have joined already are not compared, so a
group of copies makes about as many pairs as it has members. A pair is compared
only if the histograms of its sets allow the similarity: the smaller counts,
summed, are never less than what the sets share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, row_key, sieve, sift, text_key

#: Sets that share a band are compared pair by pair up to so many, and with one centre a round beyond.
SMALL_RUN = 8
#: Rounds of centres; what is still not joined then is compared pair by pair.
CENTRES = 2
#: Counts in a set's histogram; a set with a greater count than MOST has none, and is compared without.
BUCKETS, MOST = 256, (1 << 15) - 1
#: A set that many pairs need goes to so many tasks at most.
SPREAD = 32
_CHUNK = 1 << 12


@dataclass(frozen=True)
class Similar:
    """words to a shingle; bands and MinHash values to a band; the similarity num / den, from which sets are linked.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands:
    0.99997 at 0.8, 0.9999999 at 0.85.
    """

    shingle: int = 5
    bands: int = 20
    rows: int = 4
    num: int = 4
    den: int = 5


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles, or of all its words if they are fewer; A-Z count as a-z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)], np.uint64))


@functools.cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed draws, independent of each other: a mask and an odd factor for each MinHash function."""
    digest = xxhash.xxh64_intdigest
    return tuple(np.array([digest(f"{kind}{i}".encode(), 7) | odd for i in range(n)], np.uint64) for kind, odd in (("mask", 0), ("factor", 1)))


def bands(hashes: np.ndarray, scheme: Similar) -> list[int]:
    """A key for each band of the signature; a text without words has none."""
    if not len(hashes):
        return []
    mask, factor = _constants(scheme.bands * scheme.rows)
    sig = np.full(len(mask), (1 << 64) - 1, np.uint64)
    for s in range(0, len(hashes), _CHUNK):
        v = (hashes[None, s : s + _CHUNK] ^ mask[:, None]) * factor[:, None]
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x9E3779B97F4A7C15)
        sig = np.minimum(sig, v.min(1))
    return [int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), i)).view(np.int64)) for i, b in enumerate(sig.reshape(scheme.bands, scheme.rows))]


def histogram(hashes: np.ndarray) -> np.ndarray | None:
    """How many of the hashes fall into each bucket."""
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.int16) if counts.max(initial=0) <= MOST else None


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long: a bit is 1 if over half of the hashes have it. An empty set: zero."""
    counts = np.zeros(64, np.int64)
    for s in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[s : s + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def marks(docs: DataFrame, scheme: Similar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, node, m, f0, bands) of each row: text hash, digest, size and fingerprint of its shingle set, and band keys."""
    bare = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), scheme.shingle)
                nodes.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                sizes.append(len(s))
                prints.append(fingerprint(s))
                keys.append(bands(s, scheme))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "node", "m", "f0", "bands"])

    return bare.mapInArrow(run, f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, h long, node string, m long, f0 long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, scheme: Similar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, s, hist): shingle set and histogram of each node of wanted (node, one), from a row that one (doc_id, h) names.

    Only texts that a bitmap of the wanted rows lets through are shuffled.
    """
    wanted = materialize(wanted.select("node", F.col("one.doc_id").alias("id"), F.col("one.h").alias("h"), row_key("one.doc_id", "one.h").alias("key")), "wanted")
    rows = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("t_h"))
    rows = sift(rows.withColumn("key", row_key("t_id", "t_h")), materialize(sieve(wanted), "sieve"), at_all=True)
    found = wanted.join(rows, (wanted["key"] == rows["key"]) & wanted["id"].eqNullSafe(rows["t_id"]) & (wanted["h"] == rows["t_h"]))
    texts = found.select(wanted["key"], "node", "text").dropDuplicates(["key", "node"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), scheme.shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(map(histogram, sets), pa.list_(pa.int16()))], ["node", "s", "hist"])

    return texts.mapInArrow(run, "node string, s array<long>, hist array<short>")


def _sets_for(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    own = sets.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}"))
    return pairs.select(side, f"at_{side}").distinct().join(own, side)


def similar(pairs: DataFrame, sets: DataFrame, scheme: Similar) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of num / den or more."""
    pairs = pairs.select("a", "b", F.pmod(F.hash("b"), F.lit(SPREAD)).alias("at_a"), F.pmod(F.hash("a"), F.lit(SPREAD)).alias("at_b"))
    held = pairs.join(_sets_for(pairs, sets, "a"), ["a", "at_a"]).join(_sets_for(pairs, sets, "b"), ["b", "at_b"])
    both = F.size(F.array_intersect("s_a", "s_b"))
    return held.where(both * (scheme.den + scheme.num) >= scheme.num * (F.size("s_a") + F.size("s_b"))).select("a", "b")


def _may_match(m: str, n: str, scheme: Similar) -> Column:
    """Sets whose sizes are further apart than the similarity allows can't reach it."""
    return F.least(m, n) * scheme.den >= F.greatest(m, n) * scheme.num


def _shared_at_most(a: str, b: str) -> Column:
    """No two sets share more than the smaller counts of their histograms come to."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda n, x: n + x)


def _may_match_whole(a: str, b: str, m: str, n: str, scheme: Similar) -> Column:
    enough = _shared_at_most(a, b) * (scheme.den + scheme.num) >= scheme.num * (F.col(m) + F.col(n))
    return F.when(_may_match(m, n, scheme), F.coalesce(enough, F.lit(True))).otherwise(False)


def _joined_by(near: DataFrame, found: DataFrame | None, components) -> DataFrame | None:
    """(node, label) after further links (a, b): only the links between labels are followed."""
    if near.isEmpty():
        return found
    if found is None:
        return components(near)
    ends = near
    for side in "ab":
        to = found.select(F.col("node").alias("f_node"), F.col("label").alias("f_label"))
        ends = ends.join(to, ends[side] == F.col("f_node"), "left").withColumn(side, F.coalesce("f_label", side)).drop("f_node", "f_label")
    moved = components(ends)
    to = moved.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
    old = found.join(to, found["label"] == to["t_node"], "left").select("node", F.coalesce("t_label", "label").alias("label"))
    new = moved.join(found.select(F.col("node").alias("f_node")), moved["node"] == F.col("f_node"), "left_anti").select("node", "label")
    now = materialize(old.union(new), "labels")
    discard(found, moved)
    return now


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows (node, ...) with each node's label, itself where it has none."""
    if found is None:
        return rows.withColumn("label", F.col("node"))
    to = found.select(F.col("node").alias("f_node"), F.col("label").alias("f_label"))
    return rows.join(to, rows["node"] == to["f_node"], "left").select(*rows.columns, F.coalesce("f_label", "node").alias("label"))


def _frequent(active: DataFrame) -> DataFrame:
    """(key, top): the most frequent label of each run of several; what has it needs no comparison with its like, so one side of the pairs goes without."""
    counted = active.groupBy("key", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("c"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("c.label").alias("top"))


def links(shared: DataFrame, tested: DataFrame, sets: DataFrame, scheme: Similar, components) -> DataFrame | None:
    """(node, label) of all nodes that verified links join up: the pairs tested (a, b), and each that shares a key, being compared or joined already.

    shared has (node, m, key, pop): the bands that several nodes have, and in
    how many such places a node meets others. sets has what they are compared by.
    """
    found = _joined_by(materialize(similar(tested, sets, scheme), "near"), None, components)
    release(sets.sparkSession)
    active = materialize(_labelled(shared, found), "active")
    for turn in range(CENTRES + 1):
        runs = active.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("pop", "node", "m", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").drop("lo", "hi")
        runs = materialize(runs, "runs")
        if runs.isEmpty():
            break
        last = turn == CENTRES
        rows = active.select("key", "node", "m", "label")
        once = F.col("node_a") < F.col("node_b")
        if last:
            own = sets.select(F.col("node").alias("h_node"), "hist")
            rows = rows.join(materialize(_frequent(active), "frequent"), "key").join(own, F.col("node") == F.col("h_node")).drop("h_node")
            once = once | (F.col("label_b") == F.col("top_b"))
        x = rows.where("label <> top") if last else rows.join(runs.where(F.col("n") <= SMALL_RUN).select("key"), "key")
        x, y = (r.select("key", *(F.col(c).alias(f"{c}_{s}") for c in r.columns if c != "key")) for r, s in ((x, "a"), (rows, "b")))
        able = _may_match_whole("hist_a", "hist_b", "m_a", "m_b", scheme) if last else _may_match("m_a", "m_b", scheme)
        pairs = x.join(y.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & once & (F.col("label_a") != F.col("label_b")) & able)
        # a < b, each with its size; only where the frequent label was left out may they come the other way round.
        first = F.col("node_a") < F.col("node_b")
        pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.when(first, F.col("m_a")).otherwise(F.col("m_b")).alias("m_a"), F.when(first, F.col("m_b")).otherwise(F.col("m_a")).alias("m_b"))
        rest = None
        if not last:
            rest = materialize(active.join(runs.where(F.col("n") > SMALL_RUN), "key").where("node <> c.node"), "long-runs")
            centred = rest.where("label <> c.label").withColumn("c_m", F.col("c.m")).where(_may_match("m", "c_m", scheme))
            first = F.col("node") < F.col("c.node")
            pairs = pairs.union(centred.select(F.least("node", "c.node"), F.greatest("node", "c.node"), F.when(first, F.col("m")).otherwise(F.col("c_m")), F.when(first, F.col("c_m")).otherwise(F.col("m"))))
        pairs = pairs.distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if not last:
            for side in "ab":
                pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("hist").alias(f"hist_{side}")), side)
            pairs = pairs.where(_may_match_whole("hist_a", "hist_b", "m_a", "m_b", scheme))
        pairs = materialize(pairs.select("a", "b"), "pairs")
        near = materialize(similar(pairs, sets, scheme), "near")
        tested = tested.union(pairs)
        discard(runs)
        found = _joined_by(near, found, components)
        if rest is None:
            break
        now = materialize(_labelled(rest.select("node", "m", "key", "pop"), found), "active")
        discard(active, rest)
        active = now
        release(sets.sparkSession)
    discard(active)
    return found


def groups(docs: DataFrame, scheme: Similar, candidates, components, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, h (text hash), fingerprint (digest of the shingle set), component_id (smallest doc_id reachable).

    candidates makes pairs (a, b), a < b, of nodes (node, f0) with near
    fingerprints, components (node, label) of links (a, b). Texts without words are one set. A null doc_id is reached like any but is
    never the smallest; a group of nothing else has a null component_id.
    """
    prints = materialize(marks(docs, scheme, id_col=id_col, text_col=text_col), "marks")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("m").alias("m"), F.first("f0").alias("f0"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "distinct-sets")
    first = materialize(candidates(nodes.where("m > 0").select("node", "f0")), "candidates")
    release(docs.sparkSession)
    keyed = nodes.select("node", "m", F.explode("bands").alias("key"))
    several = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    shared = materialize(keyed.join(several, "key"), "shared")
    pop = shared.groupBy("node").agg(F.sum("n").alias("pop"))
    wanted = pop.select("node").union(first.select("a")).union(first.select("b"))
    sets = materialize(shingle_sets(docs, nodes.join(wanted, "node", "left_semi"), scheme, id_col=id_col, text_col=text_col), "shingle-sets")
    found = links(shared.drop("n").join(pop, "node"), first, sets, scheme, components)
    linked = nodes.select("node", "rep", F.col("node").alias("label"))
    if found is not None:
        to = found.select(F.col("node").alias("f_node"), F.col("label").alias("f_label"))
        linked = materialize(nodes.join(to, nodes["node"] == to["f_node"], "left").select("node", "rep", F.coalesce("f_label", "node").alias("label")), "labelled")
    low = materialize(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "low")
    member = linked.join(low, "label", "left").select(F.col("node").alias("m_node"), F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.col("label").alias("m_label"))
    member = materialize(member, "members")
    discard(several, shared, first, sets, low, found, linked, nodes)
    release(docs.sparkSession)
    return prints.join(member, prints["node"] == member["m_node"]).select("doc_id", "h", F.col("m_label").alias("fingerprint"), "component_id")
