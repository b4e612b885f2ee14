"""What the pipeline's stages keep and reject."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, items):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t, source in items], DOCS)


def test_line_dedup_leaves_copies_for_near_dedup(spark):
    copy = "first line of the copy\nsecond line of the copy"
    docs = [(i, f"menu\nbody {i}" if i < 40 else f"body {i}", "big") for i in range(200)] + [(1000 + i, copy, "big") for i in range(100)]
    docs += [(2000 + i, copy + "\nsmall", "small") for i in range(8)] + [(3000 + i, f"motto\ntext {i}" if i < 3 else f"text {i}", "small") for i in range(12)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, frame(spark, docs), "").collect()}
    want = {i: t.removeprefix("menu\n") for i, t, _ in docs}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_language_id_drops_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = [
        "xqzv kwrtz bbnm plkj qwrt zxcv mnbv hgfd trwq ypsd " * 6,
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "12 345 -- !!",
    ]
    extra = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(strange)], DOCS)
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), "").select("doc_id").collect()}
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    assert {r.doc_id for r in good.select("doc_id").collect()} <= got and not [i for i in got if i >= 10**6]
