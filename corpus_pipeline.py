"""The corpus pipeline: documents to a clean, unique, decontaminated mix, each stage written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, langid, linededup, mixing, simhash
from tidemill.llm.common import materialize, table, text_key

#: Texts whose language is less sure than this go, and those less like the nearest language, unless they are too short to judge.
MIN_LANGUAGE_SCORE, MIN_LIKENESS = 0.43, 0.38

#: Share of a source's distinct texts from which a line is boilerplate, and distinct texts that must hold it at the least.
LINE_RATIO, LINE_PAGES = 0.05, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is not told apart; lang is never an input of a prediction."""
    model = langid.train(docs)
    lang, score, like = (f"{n}{'_' * max(map(len, docs.columns))}" for n in ("lang", "score", "likeness"))  # longer than any column's name
    out = langid.identify(docs, model, out=lang, score=score, likeness=like)
    told = F.col(like).isNull() | ((F.col(score) >= MIN_LANGUAGE_SCORE) & (F.col(like) >= MIN_LIKENESS))
    return out.where((F.col(lang) != "und") & told).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the lines that are boilerplate of their source, exact copies counting once; n_chars follows the text."""
    out = linededup.drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES, copies_once=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, the one of smallest id."""
    return simhash.dedup(docs, simhash.SIMILAR_08)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark, 13 of its words in a row or a shorter item whole, however long they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target, taken and copies; those the mix doesn't take go.

    Columns of docs with these names are replaced. Null texts have size 0 and null sources are one source.
    """
    mix = materialize(mixing.mix(docs), "mix")
    mix = mix.groupBy("doc_id", "h", "source").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target", "taken", "copies")))
    mix = mix.select(*(F.col(c).alias(f"__{c}") for c in mix.columns)).where(F.col("__copies") > 0)
    on = docs["doc_id"].eqNullSafe(mix["__doc_id"]) & docs["source"].eqNullSafe(mix["__source"]) & (text_key(docs["text"]) == mix["__h"])
    extra = [F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies")]
    added = {"size", "source_size", "target", "taken", "copies"}
    return docs.join(mix, on).select(*(docs[c] for c in docs.columns if c not in added), *extra)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Languages, shingle sets and shuffles of this kind are beyond SQL; tests/llm/test_stages_edges.py holds run() against plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
