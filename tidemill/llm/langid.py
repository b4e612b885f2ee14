"""Language ID by hierarchical discrimination.

The language family is predicted first; within it, one-versus-one linear
support vector machines separate its languages. Features are byte pairs and
triples of the letters of the whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .linear import features, margin, sigmoid, svm

#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "indo-aryan": "hi ur bn mr gu pa ne si".split(),
    "dravidian": "ta te kn ml".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

#: Labelled texts that the classifier is fitted on, about, spread evenly over the languages.
SAMPLE = 3000
LETTER = regex.compile(r"\p{L}")
#: Fewer letters are too few to say that a text is in none of the languages.
JUDGED_LETTERS = 30
#: ASCII other than letters becomes a space.
LETTERS_ONLY = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def features_of(text: str) -> np.ndarray:
    return features(text.lower().encode().translate(LETTERS_ONLY))


def held_out(id_col: str, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text, modulo `of`, is `rest`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == rest


class Discriminator:
    """Votes of one-versus-one machines, over families and then over the languages of one."""

    def __init__(self, langs: list[str], x: np.ndarray):
        names = sorted(set(langs))
        y = np.array(langs, object)
        family = np.array([FAMILY.get(n, n) for n in langs], object)
        self.families = {f: [n for n in names if FAMILY.get(n, n) == f] for f in sorted(set(family))}
        self.machines = {pair: self._fit(x, family, *pair) for pair in itertools.combinations(self.families, 2)}
        self.within = {f: {pair: self._fit(x, y, *pair) for pair in itertools.combinations(own, 2)} for f, own in self.families.items()}
        means = np.stack([x[y == n].mean(0) for n in names])
        self.centres = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, a: str, b: str) -> np.ndarray:
        use = (y == a) | (y == b)
        return svm(x[use], np.where(y[use] == a, 1.0, -1.0).astype(np.float32))

    @staticmethod
    def _choose(names: list[str], machines: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes (then most margin), and the probability that its closest duel gives it."""
        votes, sums, worst = (np.zeros((len(x), len(names))) for _ in range(3))
        worst += np.inf
        for (a, b), w in machines.items():
            i, j, m = names.index(a), names.index(b), margin(w, x)
            for k, own in ((i, m), (j, -m)):
                votes[:, k] += own > 0
                sums[:, k] += np.clip(own, -5, 5)
                worst[:, k] = np.minimum(worst[:, k], own)
        best = np.argmax(votes + np.tanh(sums / 100) / 2, axis=1)
        duel = worst[np.arange(len(x)), best]
        return best, np.where(np.isinf(duel), 1.0, sigmoid(3 * duel))

    def likeness(self, x: np.ndarray) -> np.ndarray:
        """Cosine to the nearest mean of a learned language: low for texts that are in none of them."""
        return (x @ self.centres.T).max(1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        fam, p = self._choose(names, self.machines, x)
        out, score = np.empty(len(x), object), p.copy()
        for k, f in enumerate(names):
            at = np.flatnonzero(fam == k)
            if len(at):
                best, q = self._choose(self.families[f], self.within[f], x[at])
                out[at] = np.array(self.families[f], object)[best]
                score[at] *= q
        return out.tolist(), score


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Discriminator | None:
    """Fitted on about `sample` rows that have a text and a language, chosen by a hash, as many of each language; None without any."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    quota = -(-sample // len(counts))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, quota / n))) for k, n in sorted(counts.items())))
    picked = rows.where(F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = [(a, t) for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in use], pa.string()), pa.array([features_of(t).astype(np.float16).tobytes() for _, t in use], pa.binary())], ["lang", "x"])

    got = sorted(map(tuple, picked.mapInArrow(run, "lang string, x binary").collect()))
    if not got:
        return None
    return Discriminator([a for a, _ in got], np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32))


def identify(docs: DataFrame, model: Discriminator | None, *, text_col: str = "text", out: str = "lang_pred", score: str = "score", likeness: str | None = None) -> DataFrame:
    """docs with the predicted language, a score between 0 and 1 and, if named, the likeness to the nearest learned language.

    The likeness is null for texts of fewer than JUDGED_LETTERS letters. A null text, one without letters, or no model: `und` with score 0. Only the
    text is looked at; equal texts get equal results; all columns are kept.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    extra = [StructField(likeness, DoubleType())] if likeness else []
    schema = StructType([*docs.schema.fields, StructField(out, StringType()), StructField(score, DoubleType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores, likes = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [None] * batch.num_rows
            texts = batch.column(at)
            for s in range(0, batch.num_rows, 256):
                part = [(s + i, t) for i, v in enumerate(texts[s : s + 256]) if (t := v.as_py()) and LETTER.search(t)]
                if part and model is not None:
                    x = np.stack([features_of(t) for _, t in part])
                    pred, p = model.predict(x)
                    for (i, _), a, b in zip(part, pred, p, strict=True):
                        langs[i], scores[i] = a, b
                    if likeness:
                        for (i, t), c in zip(part, model.likeness(x).tolist(), strict=True):
                            likes[i] = c if next(itertools.islice(LETTER.finditer(t), JUDGED_LETTERS - 1, None), None) else None
            more = [pa.array(likes, pa.float64())] if likeness else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), *more], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
