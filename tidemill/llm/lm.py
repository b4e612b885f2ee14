"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting, interpolated with
add-one unigrams. Level 1 is the vocabulary: the words' 64-bit hashes in
Elias-Fano code, a word's id being its rank, with exact counts (the base score
needs them) and quantised unigram probabilities. Level 2 holds the followers
of each word: monotone pointers say where a context's followers begin, their
ids are made monotone by the context's offset, and a query is a successor
search relative to its context; each follower has a quantised smoothed
probability. Both levels are cut into shards of bounded size, files in the
shared folder which the scoring tasks map into memory.

Level 2 is cut where the counts of level 1 say that equal shares of the corpus
fall (a follower being about as frequent after a word as anywhere), so a
frequent context is spread over many shards and no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .eliasfano import EliasFano, discard, exists, open_mapped, pack, put

DISCOUNT = 0.75
#: Words to a shard of level 1, training tokens to one of level 2, tokens handled at once by a task.
VOCABULARY_SHARD, FOLLOWER_SHARD, FLUSH = 1 << 21, 1 << 22, 1 << 20
#: log10 probabilities from -RANGE to 0 in 16 bits.
RANGE, LEVELS = 24.0, 65535
MEMO = 400_000
END = b""


def _code(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10p * (-LEVELS / RANGE)), 0, LEVELS).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * (-RANGE / LEVELS)


class Hashes(dict):
    """A word's 64-bit hash, remembered; its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def text_tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end. Bytes are split at the six ASCII white-space characters only."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def _blocks(batches: Iterator[pa.RecordBatch], hashes: Hashes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows, token hashes, and tokens of each row, some FLUSH tokens together; one very long text makes one block."""
    rows, parts, sizes, n = [], [], [], 0
    for batch in batches:
        for at in range(batch.num_rows):  # one text at a time: a batch may hold 64 MB of them
            *row, text = (c[at].as_py() for c in batch.columns)
            words = text_tokens(text)
            rows.append(row)
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
            n += len(words)
            if n >= FLUSH:
                yield rows, np.concatenate(parts), np.array(sizes)
                rows, parts, sizes, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array(sizes)


class Model:
    """The trie as tasks see it; files are mapped when first needed."""

    def __init__(self, folder: str, head: dict):
        self.folder, self.head = folder, head
        self.maps: dict[str, dict] = {}
        self.bases = np.array(head["bases"], np.int64)
        self.cumulated = np.array(head["cumulated"], np.int64)
        self.shared = np.array(sorted(head.get("split", {})), np.int64)
        self.shared_types = np.array([head["split"][c] for c in self.shared.tolist()], np.int64)

    def part(self, name: str) -> dict:
        if name not in self.maps:
            arrays = open_mapped(f"{self.folder}/{name}")
            lists = {n: EliasFano.load(arrays, n) for n in ("keys", "pointers") if f"{n}.head" in arrays}
            self.maps[name] = arrays | lists
        return self.maps[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Id (-1: not in the vocabulary), count, words counted before it, code, of each hash."""
        bits = self.head["bits"]
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        ids, counts, before, code = (np.full(len(hashes), x, t) for x, t in ((-1, np.int64), (0, np.int64), (0, np.int64), (0, np.uint16)))
        for s in np.unique(shard):
            if self.bases[s + 1] == self.bases[s]:
                continue
            at, p = np.flatnonzero(shard == s), self.part(f"words-{s}")
            i = p["keys"].find(hashes[at] & np.uint64((1 << (64 - bits)) - 1))
            at, i = at[i >= 0], i[i >= 0]
            ids[at], counts[at], before[at], code[at] = i + self.bases[s], p["counts"][i], p["before"][i].astype(np.int64) + self.cumulated[s], p["codes"][i]
        return ids, counts, before, code

    def shards(self, c_count: np.ndarray, c_before: np.ndarray, w_before: np.ndarray) -> np.ndarray:
        """Shard of level 2 for a follower: never falls as (context, follower) rises."""
        place = c_before + np.floor(c_count * (w_before / self.head["n"]))
        total = self.head["n"] + self.head["texts"]
        return np.minimum((place * self.head["shards"] / total).astype(np.int64), self.head["shards"] - 1)


def _bigrams(model: Model, h: np.ndarray, sizes: np.ndarray):
    """Of the distinct words: index by token, count, words before, code; of the texts: starts; of the contexts: index
    by token, id; of the distinct pairs: key, shard, index by token, -1 where a word is not in the vocabulary."""
    uniq, which = np.unique(h, return_inverse=True)
    ids, counts, before, code = model.words(uniq)
    begin = model.head["v"]
    ctx = np.empty(len(h), np.int64)
    ctx[1:] = which[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ctx[starts] = len(uniq)
    ids_c = np.append(ids, begin)
    both = (ids[which] >= 0) & (ids_c[ctx] >= 0)
    key = (ids_c[ctx[both]].astype(np.uint64) << np.uint64(32)) | ids[which[both]].astype(np.uint64)
    keys, first, pair = np.unique(key, return_index=True, return_inverse=True)
    c, w = ctx[both][first], which[both][first]
    shard = model.shards(np.append(counts, model.head["texts"])[c], np.append(before, model.head["n"])[c], before[w])
    pairs = np.full(len(h), -1, np.int64)
    pairs[both] = pair
    return which, counts, before, code, starts, ctx, ids_c, keys, shard, pairs


def train(docs: DataFrame, *, text_col: str = "text") -> tuple[str, dict]:
    """Folder and head of the trie over all texts of docs; null texts count as empty, no rows give an empty model.

    Counts cover every training text; nothing is pruned.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "trie")
    texts = docs.select(F.col(text_col).alias("text"))

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _ in _blocks(batches, Hashes()):
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = materialize(texts.mapInArrow(unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "unigrams")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = counts.where(F.col("h") == F.xxhash64(F.lit(""))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert v < 1 << 32, "ids of words have 32 bits"
    bits = max(0, (-(-v // VOCABULARY_SHARD) - 1).bit_length())
    head = {"v": v, "n": n, "texts": ends, "bits": bits, "shards": max(1, -(-(n + ends) // FOLLOWER_SHARD))}

    def words(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        rest = rows["h"].to_numpy().view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
        order = np.argsort(rest)
        h, c = rest[order], rows["n"].to_numpy()[order]
        before = np.concatenate([[0], np.cumsum(c)[:-1]])
        small = lambda a: a.astype(np.uint32 if int(a.max(initial=0)) < 1 << 32 else np.uint64)
        put(f"{folder}/words-{s}", pack(EliasFano.build(h).arrays("keys") | {"counts": small(c), "before": small(before), "codes": _code(np.log10((c + 1) / (n + v + 1)))}))
        return pd.DataFrame({"shard": [s], "words": [len(h)], "tokens": [int(c.sum())]})

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    made = counts.withColumn("shard", shard.cast("long")).groupBy("shard").applyInPandas(words, "shard long, words long, tokens long").collect()
    by = {r["shard"]: r for r in made}
    size = [by[s]["words"] if s in by else 0 for s in range(1 << bits)]
    held = [by[s]["tokens"] if s in by else 0 for s in range(1 << bits)]
    head |= {"bases": np.concatenate([[0], np.cumsum(size)]).tolist(), "cumulated": np.concatenate([[0], np.cumsum(held)]).astype(int).tolist()}
    if not v:
        return folder, head | {"ranges": {}, "split": {}}

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, zip_ = Model(folder, head), zstandard.ZstdCompressor(level=1)
        for _, h, sizes in _blocks(batches, Hashes()):
            *_, keys, shard, pairs = _bigrams(model, h, sizes)
            c = np.bincount(pairs, minlength=len(keys)).astype(np.uint32)
            cut = np.flatnonzero(np.diff(shard)) + 1
            out = []
            for k, m in zip(np.split(keys, cut), np.split(c, cut), strict=True):
                gaps = np.diff(k, prepend=np.uint64(0))
                out.append(zip_.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + m.view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(shard[np.concatenate([[0], cut])]), pa.array(out, pa.binary())], ["shard", "part"])

    def followers(rows: pd.DataFrame) -> pd.DataFrame:
        s, un = int(rows["shard"].iloc[0]), zstandard.ZstdDecompressor()
        keys, counts = [], []
        for part in rows["part"]:
            raw = np.frombuffer(un.decompress(part), np.uint8)
            m = len(raw) // 12
            keys.append(np.cumsum(np.ascontiguousarray(raw[: 8 * m].reshape(8, m).T).view(np.uint64).ravel(), dtype=np.uint64))
            counts.append(np.ascontiguousarray(raw[8 * m :].reshape(4, m).T).view(np.uint32).ravel())
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        ctx = (keys >> np.uint64(32)).astype(np.int64)
        lo, hi = int(ctx[0]), int(ctx[-1])
        starts = np.searchsorted(ctx, np.arange(lo, hi + 2))
        values = (ctx - lo).astype(np.uint64) * np.uint64(v + 1) + (keys & np.uint64(0xFFFFFFFF))
        codes = np.minimum(c, np.iinfo(np.uint32).max).astype(np.uint32)
        arrays = EliasFano.build(values).arrays("keys") | EliasFano.build(starts).arrays("pointers") | {"counts": codes}
        put(f"{folder}/raw-{s}", pack(arrays))
        types = np.diff(starts)
        return pd.DataFrame({"shard": [s], "lo": [lo], "hi": [hi], "n_lo": [int(types[0])], "n_hi": [int(types[-1])]})

    dealt = texts.mapInArrow(bigrams, "shard long, part binary")
    ranges = dealt.groupBy("shard").applyInPandas(followers, "shard long, lo long, hi long, n_lo long, n_hi long").collect()
    # Contexts that several shards share lie at the shards' ends: two numbers a shard.
    split: dict[int, int] = {}
    for r in ranges:
        for c, m in {r["lo"]: r["n_lo"], r["hi"]: r["n_hi"]}.items():
            split[c] = split.get(c, 0) + m
    head |= {"ranges": {r["shard"]: (r["lo"], r["hi"]) for r in ranges}, "split": split}

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, head)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if exists(f"{folder}/raw-{s}") or not exists(f"{folder}/followers-{s}"):
                    _smooth(model, s)
                    discard(f"{folder}/raw-{s}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["shard"])

    names = spark.createDataFrame([(r["shard"],) for r in ranges], "shard long").repartition(max(1, min(len(ranges), 1024)))
    names.mapInArrow(smooth, "shard long").write.format("noop").mode("overwrite").save()
    return folder, head


def _by_id(model: Model, ids: np.ndarray, name: str) -> np.ndarray:
    out = np.zeros(len(ids), np.int64)
    shard = np.searchsorted(model.bases, ids, side="right") - 1
    for s in np.unique(shard):
        at = shard == s
        out[at] = model.part(f"words-{s}")[name][ids[at] - model.bases[s]]
    return out


def _smooth(model: Model, s: int) -> None:
    """Turns a shard's counts into quantised probabilities: they need the contexts' totals, known only now."""
    raw, (lo, hi) = model.part(f"raw-{s}"), model.head["ranges"][s]
    keys, pointers = raw["keys"], raw["pointers"]
    at = np.arange(hi - lo + 2)
    types = np.diff(pointers.get(at).astype(np.int64))
    own = types.copy()
    for c in (lo, hi):
        types[c - lo] = model.head["split"][c]
    v = model.head["v"]
    names = np.arange(lo, min(hi + 1, v))
    totals = np.append(_by_id(model, names, "counts"), [model.head["texts"]] * (hi + 1 - lo - len(names)))
    ctx = np.repeat(np.arange(hi - lo + 1), own)
    w = (keys.get(np.arange(keys.n)) - ctx.astype(np.uint64) * np.uint64(v + 1)).astype(np.int64)
    n, p1 = raw["counts"].astype(np.float64), (_by_id(model, w, "counts") + 1) / (model.head["n"] + v + 1)
    p = (n - DISCOUNT + DISCOUNT * types[ctx] * p1) / totals[ctx]
    put(f"{model.folder}/followers-{s}", pack({k: raw[k] for k in raw if k.startswith(("keys.", "pointers."))} | {"codes": _code(np.log10(p))}))


def _model_scores(model: Model, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Smoothed log10 probability of each distinct pair, NaN where the trie lacks it."""
    out = np.full(len(keys), np.nan)
    v = model.head["v"]
    for s in np.unique(shard):
        if s not in model.head["ranges"]:
            continue
        lo, hi = model.head["ranges"][s]
        at = np.flatnonzero(shard == s)
        c = (keys[at] >> np.uint64(32)).astype(np.int64)
        at = at[(c >= lo) & (c <= hi)]
        p = model.part(f"followers-{s}")
        x = ((keys[at] >> np.uint64(32)) - np.uint64(lo)) * np.uint64(v + 1) + (keys[at] & np.uint64(0xFFFFFFFF))
        i = p["keys"].find(x)
        out[at[i >= 0]] = _value(p["codes"][i[i >= 0]])
    return out


def _types(model: Model, ids: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Followers of each context: the distance of its pointers, or the total kept for contexts that shards share."""
    out = np.zeros(len(ids), np.int64)
    shard = model.shards(counts, before, np.zeros(len(ids)))
    for s in np.unique(shard):
        if s in model.head["ranges"]:
            lo, hi = model.head["ranges"][s]
            at = np.flatnonzero((shard == s) & (ids >= lo) & (ids <= hi))
            if len(at):
                p, i = model.part(f"followers-{s}")["pointers"], ids[at] - lo
                out[at] = (p.get(i + 1) - p.get(i)).astype(np.int64)
    if len(model.shared):
        i = np.minimum(np.searchsorted(model.shared, ids), len(model.shared) - 1)
        out = np.where(model.shared[i] == ids, model.shared_types[i], out)
    return out


def score(docs: DataFrame, folder: str, head: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words and one end; a null text has the end only.
    Words outside the vocabulary have probability 1 / (N + V + 1) and as
    contexts say nothing about what follows. Repeated rows give repeated rows.
    """
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = bare.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        head = sent.value
        model, hashes, total = Model(folder, head), Hashes(), head["n"] + head["v"] + 1
        for rows, h, sizes in _blocks(batches, hashes):
            if head["v"]:
                which, counts, before, code, starts, ctx, ids_c, keys, shard, pairs = _bigrams(model, h, sizes)
                base = np.log10((counts + 1) / total)[which]
                single = np.where(counts > 0, _value(code), np.log10(1 / total))[which]
                count_c, before_c = np.append(counts, head["texts"]), np.append(before, head["n"])
                known = np.flatnonzero(ids_c >= 0)
                types = np.zeros(len(ids_c))
                types[known] = _types(model, ids_c[known], count_c[known], before_c[known])
                with np.errstate(divide="ignore", invalid="ignore"):
                    back = np.where(types > 0, np.log10(DISCOUNT * types / count_c), 0.0)
                pair_p = np.append(_model_scores(model, keys, shard), np.nan)
                p = pair_p[pairs]
                p = np.where(np.isnan(p), back[ctx] + single, p)
                n_known = np.add.reduceat((counts > 0)[which].astype(np.int64), starts)
            else:
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                p = base = np.zeros(len(h)) + np.log10(1 / total)
                n_known = np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], to_arrow_type(kind)), pa.array(sizes.astype(np.int64)), pa.array(n_known), pa.array(np.full(len(rows), head["n"], np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(p, starts))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return bare.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
