"""Queries over the corpus tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, lm, mixing, quality, simhash, tokens, topk, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out("doc_id", 7, 2)
    folder, head = lm.train(docs.where(~out))
    return lm.score(docs, folder, head).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(urlfilter.host_rule(*r) for r in urlfilter.HOST_RULES), *map(urlfilter.token_rule, urlfilter.SPAM_TOKENS)]
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    own = (op1_decontaminate, op2_line_dedup, op3_token_counts, op4_top_k, op5_lm_score, op6_mix, op7_quality, op8_url_filter, op9_simhash, op10_language)
    return {f.__name__: f for f in own}


def _level_sql() -> str:
    return """
    docs AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS ord
      FROM documents),
    src AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM docs GROUP BY source),
    filled AS (
      SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
             (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weights
      FROM src),
    levels AS (
      SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (all_weights - coalesce(sum(weight) OVER w, 0)) AS level
      FROM filled WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    held AS (SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER () AS lev FROM levels),
    target AS (SELECT source, source_size, coalesce(least(cap, lev * weight), cap) AS target FROM held)"""


def oracle_sql() -> dict[str, str]:
    op1 = r"""
    WITH d AS (
      SELECT row_number() OVER () AS k, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    b AS (
      SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    win AS (
      SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    place AS (
      SELECT k, n, w[i:i + n - 1] AS win, i
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT k, i, n, item_id FROM place JOIN win USING (n, win)),
    words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
    items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""
    op2 = r"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
    l AS (SELECT k, source, i, parts[i] AS line, trim(translate(parts[i], chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS bare
          FROM (SELECT k, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM d WHERE text IS NOT NULL)),
    t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
    p AS (SELECT source, bare, count(DISTINCT k) AS pages FROM l WHERE bare <> '' GROUP BY source, bare),
    bad AS (SELECT p.source, bare FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source WHERE pages >= 3 AND pages > total * {ratio}::DOUBLE),
    kept AS (
      SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE bad.bare IS NOT NULL) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.bare IS NULL), '') AS text
      FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.bare = bad.bare GROUP BY k)
    SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(kept.text) AS text_sha256
    FROM d LEFT JOIN kept USING (k)""".replace("{ratio}", str(linededup.RATIO))
    op4 = """
    WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON len(q.v) = len(c.v) AND c.k <> q.k WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
    op6 = (
        "WITH "
        + _level_sql()
        + """,
    flow AS (
      SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto
      FROM docs d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
    queue AS (
      SELECT flow.*, epoch, CASE WHEN target > 0 THEN CAST(source_size * epoch + upto AS DOUBLE) / target END AS finish
      FROM flow, (SELECT unnest([0, 1]) AS epoch)),
    run AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS FIRST, ord, epoch ROWS UNBOUNDED PRECEDING) AS all_upto FROM queue WHERE finish IS NOT NULL),
    got AS (SELECT doc_id, ord, source, count(*) AS copies FROM run WHERE all_upto <= (SELECT floor(sum(target) + 0.001) FROM target) GROUP BY ALL),
    same AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord, source) AS i, count(*) OVER (PARTITION BY doc_id, ord, source) AS n FROM flow)
    SELECT s.doc_id, s.size, source_size, target,
           CAST(s.size * (coalesce(copies, 0) // n + CASE WHEN i <= coalesce(copies, 0) % n THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM same s LEFT JOIN got g ON s.ord = g.ord AND s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.source IS NOT DISTINCT FROM g.source"""
    )
    cases = "\n".join(
        f"UNION ALL SELECT '{v}', '{h}', '{p}'" if i else f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p"
        for i, (v, h, p) in enumerate(urlfilter.HOST_RULES)
    )
    spam = "|".join(urlfilter.SPAM_TOKENS)
    op8 = f"""
    WITH rest AS (
      SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(\\?.*)$', 1) AS query FROM rest),
    rules AS ({cases}),
    fit AS (
      SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS i
      FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule,
           coalesce(verdict, CASE WHEN regexp_matches(lower(host || path || query), '(^|[^a-z0-9])({spam})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN fit ON parts.k = fit.k AND i = 1"""
    return {"op1_decontaminate": op1, "op2_line_dedup": op2, "op4_top_k": op4, "op6_mix": op6, "op8_url_filter": op8}
