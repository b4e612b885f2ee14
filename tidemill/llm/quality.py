"""Quality classifier by weak labels.

Heuristic labellers call a text good or bad or pass. Expectation-maximisation
over the counts of their vote patterns estimates how far each can be trusted,
and a posterior for each pattern; the posteriors train a hashed linear scorer
on the text itself. Patterns are few (three votes to the power of the
labellers), so the estimate covers all documents at a bounded size.

Toxic texts are told by a list of insults and, where labels are given, by
marks learned from a bounded sample of labelled rows: words and word beginnings
far more frequent in toxic texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .linear import features, logistic, margin, sigmoid

#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is was it for with that this as be by on are at from or an not have "
        "der die das und ist ein nicht mit auf für den dem des von zu im sich eine als auch "
        "le la les de des et un une que est en pour dans qui sur par au pas plus du "
        "el los las y que del se por con para una su al lo como más pero sus"
    ).split()
)
#: Insults.
INSULTS = frozenset(
    w.encode()
    for w in (
        "idiot idiots moron morons stupid scum loser losers clown clowns trash worthless disgusting pathetic "
        "dumb imbecile filth vermin retard bastard jerk "
        "idioten dummkopf abschaum arschloch widerlich "
        "imbécile crétin ordure connard débile "
        "imbécil estúpido basura escoria idiota"
    ).split()
)
SYMBOLS = b"#$%&*|{}<>=+^~\\@_"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = b"abcdefghijklmnopqrstuvwxyz"
EDGES = b".,;:!?\"'()[]#$%&*|-"
PASS, GOOD, BAD = 0, 1, 2

#: Texts the scorer is fitted on, about; words to an insult from which a text counts as toxic; bytes of short texts.
SAMPLE, TOXIC_WORDS, SHORT = 4000, 200, 200


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else PASS


def votes(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Of the labellers: symbols, words with symbols, capitals, shouting, function words, length, words said again at once, a favourite word, sentence ends."""
    n, m = max(len(raw), 1), max(len(words), 1)
    symbols = (len(raw) - len(raw.translate(None, SYMBOLS))) / n
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    lower = len(raw) - len(raw.translate(None, SMALL))
    capitals = upper / max(upper + lower, 1)
    stops = sum(map(STOP_WORDS.__contains__, (w.strip(EDGES) for w in raw.lower().split()))) / m
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    favourite = max(Counter(words).values(), default=0) / m
    ends = sum(raw.count(c) for c in (b". ", b".\n", b"! ", b"!\n", b"? ", b"?\n")) + (raw[-1:] in (b".", b"!", b"?"))
    shouting = raw.count(b"!!") / m
    odd = sum(w[-1] in SYMBOLS for w in words) / m
    return (
        _vote(symbols < 0.01, symbols > 0.03),
        _vote(odd < 0.02, odd > 0.1),
        _vote(capitals < 0.15, capitals > 0.4),
        _vote(shouting == 0, shouting > 0.05),
        PASS if m < 20 else _vote(stops > 0.1, stops < 0.04),
        _vote(m >= 40, m < 3),
        PASS if m < 10 else _vote(again < 0.02, again > 0.1),
        PASS if m < 20 else _vote(favourite < 0.15, favourite > 0.2),
        PASS if m < 20 else _vote(ends / m > 0.02, ends / m < 0.005),
    )


LABELLERS = 9
#: Bad texts come in kinds, each seen by some labellers only: symbols, capitals, repetition, no prose.
KINDS = ((0, 1), (2, 3), (6, 7), (4, 8))


def pattern(text: str) -> int:
    raw = text.encode()
    return sum(v * 3**i for i, v in enumerate(votes(raw, raw.split())))


def insults(words: list[bytes]) -> tuple[int, int]:
    return sum(map(INSULTS.__contains__, (w.strip(EDGES) for w in words))), len(words)


#: Hashed marks; texts that a mark must occur in; log ratio of its rates from which it counts, and its greatest weight;
#: words added to a text's length, so that short texts need more; share of clean sampled texts that may be caught.
MARKS, MARK_TEXTS, MARK_RATIO, MARK_MOST, MARK_WORDS, FALSE_ALARMS = 1 << 16, 5, 3.0, 6.0, 20, 0.003
#: Rates of marks are summed as whole numbers of this size, so the order of summing doesn't matter.
RATE_UNIT = 10**9
#: Words of so many are remembered by a task, then forgotten together.
MEMO = 500_000


def mark_keys(word: bytes) -> set[int]:
    """Hashes of a word and of its first 4, 5 and 6 letters."""
    w = word.strip(EDGES).decode("utf-8", "ignore")
    return {zlib.crc32(k.encode()) % MARKS for k in (w, *(w[:n] + "_" for n in (4, 5, 6)))} if w else set()


class MarkWeights(dict):
    """Greatest weight among a word's marks, 0 without any; worked out on first sight."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = w = max((self.weights.get(k, 0.0) for k in mark_keys(word)), default=0.0)
        return w


def mark_score(words: list[bytes], memo: MarkWeights) -> float:
    """Weight of the marked words by length of the text; a single marked word says nothing."""
    found = [w for w in map(memo.__getitem__, words) if w]
    return sum(found) / (len(words) + MARK_WORDS) if len(found) > 1 else 0.0


def learn_marks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[int, float], float] | None:
    """Weights of the marks and the score above which a text is toxic; None without both toxic and clean labelled texts.

    Fitted on the texts of about `sample` labelled ids, chosen by a hash; an id
    labelled both ways counts as toxic. Null ids, labels and texts take no
    part. What reaches the driver is a sum for each of at most MARKS hashes.
    """
    known = labels.select(F.col(label_id).alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__id is not null and __toxic is not null").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    total = known.count()
    if not total:
        return None
    # About `sample` rows of an id and a flag: small enough to be sent to all.
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < min(1.0, sample / total) * float(1 << 30))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    rows = materialize(rows.select("text", (F.col("__toxic") > 0).alias("toxic")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (n.get(True) and n.get(False)):
        return None

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, MARKS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = text.as_py().lower().encode().split()
                counts: Counter = Counter()
                for w, k in Counter(words).items():
                    for key in mark_keys(w):
                        counts[key] += k
                if counts:
                    at = np.fromiter(counts, np.int64, len(counts))
                    sums[0 if toxic else 1, at] += np.fromiter(counts.values(), np.int64, len(counts)) * RATE_UNIT // len(words)
                    sums[2, at] += toxic
        keys = np.flatnonzero(sums[:2].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x[keys]) for x in sums)], ["key", "bad", "good", "texts"])

    got = rows.mapInArrow(rates, "key long, bad long, good long, texts long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("texts").alias("texts"))
    ratio = F.log((F.col("bad") / (n[True] * RATE_UNIT) + 1e-5) / (F.col("good") / (n[False] * RATE_UNIT) + 1e-5))
    got = got.where(F.col("texts") >= MARK_TEXTS).select("key", ratio.alias("ratio")).where(F.col("ratio") > MARK_RATIO)
    weights = {r["key"]: min(r["ratio"], MARK_MOST) for r in got.collect()}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = MarkWeights(weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mark_score(t.as_py().lower().encode().split(), memo) for t in batch.column(0)], pa.float64())], ["score"])

    clean = rows.where("not toxic").select("text").mapInArrow(scores, "score double")
    # However clean the sample, a marked word in more than TOXIC_WORDS others says nothing.
    return weights, max(clean.agg(F.percentile("score", F.lit(1 - FALSE_ALARMS))).first()[0], MARK_RATIO / TOXIC_WORDS)


def fit(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of good by pattern, P(bad vote | class, a vote) by class and labeller, and the classes' shares.

    Class 0 is good, the others are the kinds of bad text: with one class for
    all of them the estimate would follow the largest kind alone. A labeller
    that passes says nothing. Begins with few false alarms and labellers that
    see their own kind; ends when nothing moves. Counts are smoothed, so a vote
    never seen isn't impossible.
    """
    table = np.full((1 + len(KINDS), LABELLERS), 0.05)
    for k, own in enumerate(KINDS):
        table[1 + k, list(own)] = 0.8
    share = np.array([0.9, *[0.1 / len(KINDS)] * len(KINDS)])
    if not counts:
        return {}, table, share
    start_table, start_share = table.copy(), share.copy()
    keys = np.array(sorted(counts))
    n = np.array([counts[k] for k in keys], float)
    v = np.stack([(keys // 3**i) % 3 for i in range(LABELLERS)], axis=1)
    is_good, is_bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    for _ in range(rounds):
        log = np.log(share) + is_bad @ np.log(table).T + is_good @ np.log(1 - table).T
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w = (p * n[:, None]).T
        bad, good = w @ is_bad, w @ is_good
        new = (bad + start_table) / (bad + good + 1)
        moved = np.abs(new - table).max()
        table, share = new, (w.sum(1) + start_share) / (n.sum() + 1)
        if moved < 1e-7:
            break
    return dict(zip(keys.tolist(), p[:, 0].tolist(), strict=True)), table, share


def scorer_features(text: str) -> np.ndarray:
    """A few bytes say little: texts of less than SHORT bytes have smaller features, which leaves them near the bias."""
    raw = text.encode()
    return features(raw) * np.float32(min(1.0, len(raw) / SHORT))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, pattern, posterior, score, toxic, keep.

    posterior is the labellers' verdict, score the linear scorer's (both 0 to
    1); toxic: two insults, or one in a text of at most
    TOXIC_WORDS words, or marks learned from labels (doc_id, toxic) where they
    are given; keep: score of 0.5 or more and not toxic. Null texts and texts without words score 0 and
    aren't kept. Equal texts get equal results; repeated rows give repeated
    rows; an empty table gives an empty result; other columns aren't looked at.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for t in batch.column(0):
                if (s := t.as_py()) and not s.isspace():
                    k = pattern(s)
                    counts[k] = counts.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    rows = bare.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}
    posterior, _, _ = fit(counts)
    total = sum(counts.values())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = [s for t in batch.column(0) if (s := t.as_py()) and not s.isspace()]
            yield pa.RecordBatch.from_arrays([pa.array([pattern(s) for s in use], pa.int64()), pa.array([scorer_features(s).astype(np.float16).tobytes() for s in use], pa.binary())], ["pattern", "x"])

    weights = None
    if total:
        part = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) < min(1.0, sample / total) * float(1 << 30)
        got = sorted(map(tuple, bare.where("text is not null").where(part).select("text").mapInArrow(chosen, "pattern long, x binary").collect()))
        if got:
            x = np.stack([np.frombuffer(b, np.float16) for _, b in got]).astype(np.float32)
            p = np.array([posterior[k] for k, _ in got], np.float32)
            weights = logistic(x, p)
    marks = None if labels is None else learn_marks(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    sent = spark.sparkContext.broadcast((posterior, weights, marks))
    kind = bare.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, marks = sent.value
        memo, limit = (MarkWeights(marks[0]), marks[1]) if marks else (None, 0.0)
        for batch in batches:
            out = []
            for t in batch.column(1):
                s = t.as_py()
                if not s or s.isspace():
                    out.append((None, 0.0, 0.0, False))
                    continue
                k = pattern(s)
                low = s.lower().encode().split()
                bad, n = insults(low)
                marked = memo is not None and mark_score(low, memo) > limit
                p = posterior.get(k, 0.5)
                score = p if weights is None else float(sigmoid(margin(weights, scorer_features(s))))
                out.append((k, p, score, marked or bad >= 2 or bad * TOXIC_WORDS >= max(n, 1)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "pattern", "posterior", "score", "toxic"])

    out = bare.mapInArrow(scored, f"doc_id {kind}, pattern long, posterior double, score double, toxic boolean")
    return out.withColumn("keep", (F.col("score") >= 0.5) & ~F.col("toxic"))
