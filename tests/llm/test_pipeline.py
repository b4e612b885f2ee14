"""The pipeline's stages and the registered queries."""

import collections
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import __spark_entry__
import corpus_pipeline
from tidemill.llm import decontaminate, queries

TABLES = "documents benchmark pages embeddings labels conversations".split()


def same(got, want):
    key = lambda r: tuple((c, f"{v:.9g}" if isinstance(v, float) else repr(v)) for c, v in sorted(r.items()))
    assert collections.Counter(map(key, got)) == collections.Counter(map(key, want))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    same([r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()], want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.queries()[name](spark, sf_dir).count() == n


def test_stages_chain_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        seen.append((name, before, out.count()))
        assert out.columns == columns if name != "mixing" else out.columns[: len(columns)] == columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        if name == "line_dedup":
            assert out.where("length(text) <> n_chars").count() == 0 and out.count() == before
        if name == "simhash_near_dedup":
            assert out.select("text").distinct().count() == out.count()
        if name == "decontamination":
            found = decontaminate.contamination(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert found.where("contaminated").count() == 0
        docs = out
    assert [n for n, _, _ in seen] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    assert docs.where("taken > 0 and taken <= 2 * size").count() == docs.where("size > 0").count() > 0


def test_pipeline_is_registered():
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
