"""Layered, order-dependent dedup: url, exact text, near text, title and date.

A row is dropped if its url key came before, or if a row kept before it shares
its text hash, a MinHash band, or its title and date. The kept rows are found
in rounds over a table of (row, layer, key): a row with a kept earlier holder
of one of its keys is dropped; one that is the earliest undecided holder of all
its keys is kept. Keys are only ever aggregated to their earliest holders, so a
key that many rows share makes no pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import norm_date, norm_title
from ..functions.urls import normalize_url
from ..tables import written

BANDS, ROWS = 9, 13
CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
PRIME = (1 << 31) - 1
#: Fixed draws, independent of each other; multiples of one pair would make the functions' minima go together.
_A, _B = (np.array([1 + xxhash.xxh64_intdigest(f"{k}{i}".encode(), 7) % (PRIME - 1) for i in range(BANDS * ROWS)], np.uint64) for k in "ab")
#: Characters of texts whose signatures are worked out together, and shingles at a time: few enough that their arrays stay near a core.
GROUP, STEP = 1 << 18, 16384
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_MD5_TURNS = np.array([t for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in r * 4], np.uint32)


def windows(text: str) -> set[str]:
    """The shingles of functions.text, for use in Python: three words, or three characters of texts that begin with any CJK."""
    low = text.lower()
    if CJK.search(low[:200]):
        chars = "".join(low.split())
        return {chars[i : i + 3] for i in range(max(1, len(chars) - 2))}
    words = low.split()
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The shingles of windows, repeats included, as places in one string of bytes: where each begins and ends."""
    low = text.lower()
    cjk = CJK.search(low[:200])
    data = ("" if cjk else " ").join(low.split()).encode()
    raw = np.frombuffer(data, np.uint8)
    if cjk:
        begin = np.flatnonzero((raw & 0xC0) != 0x80)
        end = np.append(begin[1:], len(data))
    else:
        gap = np.flatnonzero(raw == 32)
        begin, end = np.append(0, gap + 1), np.append(gap, len(data))
    n = max(1, len(begin) - 2)
    return data, begin[:n], end[-n:]


def md5_heads(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 4 bytes of the MD5 of each span, as a big-endian number: spans of one block side by side, longer ones by hashlib."""
    size, out = end - begin, np.empty(len(begin), np.uint32)
    padded = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(64), np.uint8), 64)
    short = np.flatnonzero(size < 56)
    for k in range(0, len(short), STEP):
        at = short[k : k + STEP]
        n = size[at]
        block = padded[begin[at]] * (np.arange(64) < n[:, None])
        block[np.arange(len(at)), n] = 0x80
        word = np.ascontiguousarray(block.view("<u4").T)
        word[14] = n * 8
        a, b, c, d = (np.full(len(at), x, np.uint32) for x in _MD5_START)
        for i, (sine, turn) in enumerate(zip(_MD5_SINES, _MD5_TURNS, strict=True)):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += sine
            f += word[g]
            a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
        out[at] = (a + np.uint32(_MD5_START[0])).byteswap()
    for i in np.flatnonzero(size >= 56).tolist():
        out[i] = int.from_bytes(hashlib.md5(data[begin[i] : end[i]]).digest()[:4], "big")
    return out


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, functions): the least (a * h + b) % PRIME over each text's hashes, h from its place in first up to the next one's."""
    out = np.full((BANDS * ROWS, len(first)), PRIME, np.uint32)
    for k in range(0, len(h), STEP):
        part = h[k : k + STEP]
        i, j = np.searchsorted(first, k, "right") - 1, np.searchsorted(first, k + len(part))
        cut = np.maximum(first[i:j] - k, 0)
        for a, b, least in zip(_A, _B, out, strict=True):
            x = part * a
            x += b
            # 2^31 is 1 modulo PRIME: the sum of both halves is under 2 * PRIME, and subtracting PRIME from less wraps to more.
            y = x >> np.uint64(31)
            x &= np.uint64(PRIME)
            x += y
            x = x.astype(np.uint32)
            np.minimum(least[i:j], np.minimum.reduceat(np.minimum(x, x - np.uint32(PRIME)), cut), out=least[i:j])
    return out.T


def band_keys(texts: list[str]) -> list[list[int]]:
    """A hash for each band of each text's MinHash signature."""
    parts = [spans(t) for t in texts]
    at = np.cumsum([0] + [len(d) for d, _, _ in parts])
    begin, end = (np.concatenate([p[k] + o for p, o in zip(parts, at)]) for k in (1, 2))
    h = md5_heads(b"".join(d for d, _, _ in parts), begin, end) % np.uint32(PRIME)
    first = np.cumsum([0] + [len(b) for _, b, _ in parts])[:-1]
    sig = np.ascontiguousarray(minima(h.astype(np.uint64), first), np.uint64)
    return [[xxhash.xxh64_intdigest(band.tobytes()) >> 1 for band in s.reshape(BANDS, ROWS)] for s in sig]


@F.pandas_udf(ArrayType(LongType()))
def minhash_bands(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A hash for each band of the MinHash signature of a text's shingles; null texts have none."""
    for part in parts:
        out, group, size = [None] * len(part), [], 0
        for i, text in enumerate(part):
            if text is not None:
                group.append((i, text))
                size += len(text)
            if group and (size >= GROUP or i == len(part) - 1):
                for (k, _), bands in zip(group, band_keys([t for _, t in group]), strict=True):
                    out[k] = bands
                group, size = [], 0
        yield pd.Series(out)


# It isn't random, but the planner would run a deterministic one a second time for a filter that it adds to what is made of its arrays.
minhash_bands = minhash_bands.asNondeterministic()


def layered(docs: DataFrame, *, near: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """docs (seq, url, text, title, publish_date) with url_key, kept, reason, dup_type, duplicate_of (seq) and original_key.

    seq orders the rows and is unique. Reasons in order: url, exact, near, title
    and date. existing has the same columns and lower seqs: articles of earlier
    runs, which count as kept whatever they share, and aren't returned.
    """
    docs = docs.withColumn("forced", F.lit(False))
    if existing is not None:
        docs = docs.unionByName(existing.withColumn("forced", F.lit(True)))
    title, date = norm_title(F.col("title")), norm_date(F.col("publish_date"))
    base = docs.select("seq", "forced", normalize_url(F.col("url")).alias("url_key"), F.sha2("text", 256).alias("sha"), F.when(title.isNotNull() & date.isNotNull(), F.concat_ws("\x1f", title, date)).alias("td"), "text")
    base = written(base.withColumn("bands", minhash_bands("text") if near else F.lit(None).cast("array<bigint>")).drop("text").where("url_key is not null"), "keys")
    # The earliest of each url key by an aggregate, which combines before its shuffle, not by a window over all its rows.
    rows = base.select("seq", "forced", "url_key")
    rows = written(rows.join(rows.groupBy("url_key").agg(F.min("seq").alias("first")), "url_key"), "firsts")
    again = rows.where("not forced and seq <> first")
    keys = [(2, F.col("sha")), (4, F.col("td")), *((3, F.get("bands", F.lit(i)).cast("string")) for i in range(BANDS if near else 0))]
    keys = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(i).alias("slot"), k.alias("key")) for i, (n, k) in enumerate(keys)))
    held = base.join(again, "seq", "left_anti").select("seq", "forced", F.explode(keys).alias("k")).select("seq", "forced", "k.*").where("key is not null")
    # A key that one row holds decides nothing. Those of several go by their slot and earliest holder, who has one key in it.
    shared = held.groupBy("slot", "key").agg(F.min("seq").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = written(held.join(shared, ["slot", "key"]).select("seq", "forced", "layer", "slot", "holder"), "links")
    state = written(links.select("seq", "forced").distinct().select("seq", F.when(F.col("forced"), True).alias("kept")), "state")
    while not state.where("kept is null").isEmpty():
        known = links.join(state, "seq")
        low = known.groupBy("slot", "holder").agg(F.min(F.when(F.col("kept"), F.col("seq"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("seq"))).alias("u"))
        seen = known.where("kept is null").join(low, ["slot", "holder"])
        per = seen.groupBy("seq").agg(F.bool_or(F.coalesce(F.col("k") < F.col("seq"), F.lit(False))).alias("hit"), F.bool_and(F.col("u") == F.col("seq")).alias("earliest"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.col("earliest"), True)
        state = written(state.join(per, "seq", "left").select("seq", new.alias("kept")), "state")
    kept = links.join(state.where("kept"), "seq").groupBy("slot", "holder").agg(F.min("seq").alias("orig"))
    why = links.join(state.where("not kept"), "seq").join(kept, ["slot", "holder"]).where("orig < seq").groupBy("seq").agg(F.min(F.struct("layer", "orig")).alias("w"))
    # Only what is dropped looks for its original: all others would meet in the task of null.
    dropped = again.select("seq", F.lit(1).alias("layer"), F.col("first").alias("duplicate_of")).unionByName(why.select("seq", "w.layer", F.col("w.orig").alias("duplicate_of")))
    dropped = dropped.join(rows.select(F.col("seq").alias("duplicate_of"), F.col("url_key").alias("original_key")), "duplicate_of")
    layer = F.col("layer")
    return rows.where("not forced").join(dropped, "seq", "left").select(
        "seq", "url_key", layer.isNull().alias("kept"),
        F.when(layer == 1, "duplicate_url").when(layer == 2, "duplicate_content:exact_hash").when(layer == 3, "duplicate_content:near_duplicate_of").when(layer == 4, "duplicate_title_date").alias("reason"),
        F.when(layer == 1, "url").when(layer == 2, "exact_content").when(layer.isin(3, 4), "near_content").alias("dup_type"),
        "duplicate_of", "original_key",
    )


def statistics(articles: DataFrame) -> DataFrame:
    """One row: distinct url keys, text hashes and titles with dates of articles (url, text, title, publish_date), and the texts indexed."""
    title, date = norm_title(F.col("title")), norm_date(F.col("publish_date"))
    return articles.agg(
        F.count_distinct(normalize_url(F.col("url"))).alias("unique_urls"), F.count_distinct(F.sha2("text", 256)).alias("unique_content_hashes"),
        F.count_distinct(F.when(title.isNotNull() & date.isNotNull(), F.concat_ws("\x1f", title, date))).alias("unique_title_dates"), F.count("text").alias("lsh_index_size"),
    )
