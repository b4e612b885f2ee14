"""SQL of whole crawl steps: extraction, layered dedup, outcomes and what follows from them.

Written from the rules, not from the operators: dedup walks its rows one by one
in a recursive query where the operator works in rounds. The driver's pages hold
no JSON-LD, OpenGraph or canonical link, so author, date, summary and canonical
address are null here; tests hold these to hand-written pages.
"""

from __future__ import annotations

from ..functions import blocks, html, text, urls
from ..operators import dedup

NET = r"regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"


def words(names) -> str:
    return ", ".join(f"'{w}'" for w in names)


def url_parts(src: str = "pages") -> str:
    return rf"p AS (SELECT page_id, url, {NET} AS net, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM {src})"


def classify(src: str = "pages") -> str:
    """page_id, page_type, reason."""
    return rf"""WITH {url_parts(src)}, k AS (SELECT *, lower(path) AS low, list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') AND list_contains([{words(urls.JUNK_PARAMS)}], split_part(x, '=', 1))) AS junk FROM p)
      SELECT page_id, CASE WHEN regexp_matches(low, '{urls.JUNK}') OR regexp_matches(url, '{urls.PAGINATION}') OR regexp_matches(low, '{urls.CALENDAR}') OR len(junk) > 0 THEN 'skip'
        WHEN regexp_matches(low, '{urls.HINT}') OR slug THEN 'article' ELSE 'skip' END AS page_type,
        CASE WHEN regexp_matches(low, '{urls.JUNK}') THEN 'junk_path_segment' WHEN regexp_matches(url, '{urls.PAGINATION}') THEN 'pagination' WHEN regexp_matches(low, '{urls.CALENDAR}') THEN 'calendar_trap'
        WHEN len(junk) > 0 THEN 'junk_query_param:' || array_to_string(list_sort(list_transform(junk, lambda x: split_part(x, '=', 1))), ',') WHEN regexp_matches(low, '{urls.HINT}') THEN 'article_path_hint' WHEN slug THEN 'article_slug' ELSE 'no_article_signal' END AS reason
      FROM (SELECT *, regexp_matches(s, '(?i)[a-z]{{3,}}') AND length(s) > 5 AS slug FROM (SELECT *, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS s FROM k))"""


def normalize(src: str = "pages") -> str:
    """page_id, url_key."""
    return rf"""WITH {url_parts(src)}, h AS (SELECT *, regexp_replace(lower(split_part(net, ':', 1)), '^www\.', '') AS host,
        list_sort(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') AND NOT list_contains([{words(urls.STRIP_PARAMS)}], lower(split_part(x, '=', 1))))) AS kv FROM p)
      SELECT page_id, 'https://' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT list_contains([{words(urls.ALT_SEGMENTS)}], lower(x))), '/') || CASE WHEN len(kv) > 0 THEN '?' || array_to_string(kv, '&') ELSE '' END AS url_key FROM h"""


def trap(src: str = "pages") -> str:
    return f"WITH {url_parts(src)} SELECT page_id, length(path) - length(replace(path, '/', '')) > 8 OR length(query) - length(replace(query, '&', '')) >= 3 AS trap, contains(lower(path), 'sitemap') AS sitemap FROM p"


def candidates(src: str) -> str:
    """page_id of the rows of src whose address may be an article's."""
    return f"SELECT c.page_id FROM ({classify(src)}) c JOIN ({trap(src)}) t USING (page_id) WHERE page_type = 'article' AND NOT trap AND NOT sitemap"


PAGE_LINKS = r"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, full_url AS link FROM (
    SELECT page_id, url, i, CASE WHEN starts_with(h[i], '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || h[i] ELSE h[i] END AS full_url, h[i] AS raw FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT page_id, url, list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: trim(x)) AS h FROM pages)))
    WHERE raw <> '' AND NOT starts_with(raw, '#') AND NOT starts_with(raw, 'mailto:') AND regexp_extract(full_url, '^[^:/?#]+://([^/?#]*)', 1) = regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"""


def body() -> str:
    out = "coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), html)"
    for pattern, by in html.BODY_STEPS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), by.replace("'", "''"))
    return f"SELECT page_id, CASE WHEN length(b) >= 200 THEN b END AS main_text FROM (SELECT page_id, {out} AS b FROM pages)"


_FOUND = " || ".join(rf"regexp_extract_all(html, '(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>', 1)" for n in (1, 2, 3))
HEADINGS = rf"list_slice(list_filter(list_transform({_FOUND}, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g'))), lambda x: length(x) > 3), 1, 10)"
LANG = r"""nullif(regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*["'']?([^"''\s>]+)', 1), '')"""
CONTENT_TYPE = r"CASE WHEN regexp_matches(path, '/wiki/|^/wiki') THEN 'wiki' WHEN regexp_matches(path, '/news/|/article/|noticia|actualite') THEN 'news' WHEN regexp_matches(path, '/blog/|/post/|/posts/') THEN 'blog' ELSE 'article' END"


def score_parts(src: str) -> str:
    """src (body, title, author, date, n_headings, language, fresh) with score: the nine rounded parts, summed."""
    return f"""SELECT *, round(least(0.0::DOUBLE + round(least(length(body) / (CASE WHEN cjk THEN 1000 ELSE 3000 END)::DOUBLE, 1) * 0.25::DOUBLE, 3) + CASE WHEN coalesce(title, '') <> '' THEN 0.10::DOUBLE ELSE 0 END
        + CASE WHEN coalesce(author, '') <> '' THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN coalesce(date, '') <> '' THEN 0.05::DOUBLE ELSE 0 END + round(least(n_headings / 3::DOUBLE, 1) * 0.10::DOUBLE, 3) + CASE WHEN coalesce(language, '') <> '' THEN 0.10::DOUBLE ELSE 0 END
        + round(least(sentences / (CASE WHEN cjk THEN 5 ELSE 10 END)::DOUBLE, 1) * 0.10::DOUBLE, 3) + round(fresh * 0.10::DOUBLE, 3)
        + round(CASE WHEN len(w) < 20 OR w IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least((len(list_distinct(w)) / len(w)::DOUBLE - 0.25::DOUBLE) / 0.40::DOUBLE, 1.0::DOUBLE)) END * 0.10::DOUBLE, 3), 1), 3) AS score
      FROM (SELECT *, len(regexp_extract_all(substr(body, 1, 200), '{text.CJK}')) > length(substr(body, 1, 200)) * 0.2 AS cjk, list_slice(regexp_extract_all(lower(body), '{text.WORD}'), 1, 400) AS w,
        len(list_filter(string_split_regex(body, '{text.SENTENCE_ENDS}'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) AS sentences FROM ({src}))"""


def extracted() -> str:
    """page_id and the article's columns."""
    own = rf"""SELECT page_id, url, {NET} AS source_domain, main_text, coalesce(main_text, '') AS body, NULL::VARCHAR AS author, NULL::VARCHAR AS date, 0.0::DOUBLE AS fresh, len({HEADINGS}) AS n_headings, lower(substr({LANG}, 1, 2)) AS language,
        nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')), '') AS title, lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) AS path
      FROM pages JOIN ({body()}) USING (page_id)"""
    return f"SELECT page_id, NULL::VARCHAR AS canonical_url, title, author, date AS publish_date, language, NULL::VARCHAR AS summary, main_text, source_domain, {CONTENT_TYPE} AS content_type, score AS quality_score FROM ({score_parts(own)})"


def dedup_steps(rows: str) -> str:
    """CTEs (to follow WITH RECURSIVE) up to found (seq, url_key, kept, layer, orig, original_key) of rows (seq, url_key, text, td)."""
    perms = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(dedup._A.tolist(), dedup._B.tolist(), strict=True)))
    return rf"""r AS ({rows}),
      low AS (SELECT seq, lower(text) AS low FROM r WHERE text IS NOT NULL),
      unit AS (SELECT seq, regexp_matches(substr(low, 1, 200), '{text.CJK}') AS cjk, regexp_replace(low, '\s+', '', 'g') AS ch, list_filter(string_split_regex(low, '\s+'), lambda x: x <> '') AS w FROM low),
      sh AS (SELECT seq, unnest(list_distinct(CASE WHEN cjk THEN list_transform(range(1, greatest(1, length(ch) - 2) + 1), lambda i: substr(ch, i, 3))
        ELSE list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END)) AS s FROM unit),
      hs AS (SELECT DISTINCT seq, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {dedup.PRIME} AS h FROM sh),
      perm(i, a, b) AS (VALUES {perms}),
      sig AS (SELECT seq, i, min((a * h + b) % {dedup.PRIME}) AS m FROM hs, perm GROUP BY seq, i),
      band AS (SELECT seq, i // {dedup.ROWS} AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS key FROM sig GROUP BY seq, i // {dedup.ROWS}),
      firsts AS (SELECT seq, url_key, min(seq) OVER (PARTITION BY url_key) AS first FROM r),
      held AS (SELECT k.* FROM (SELECT seq, 2 AS layer, sha256(text) AS key FROM r WHERE text IS NOT NULL UNION ALL SELECT seq, 4, td FROM r WHERE td IS NOT NULL UNION ALL SELECT seq, 3, band || ':' || key FROM band) k
        JOIN firsts f ON k.seq = f.seq AND f.seq = f.first),
      clash AS (SELECT b.seq, list(DISTINCT a.seq) AS before, row_number() OVER (ORDER BY b.seq) AS k FROM held a JOIN held b ON a.layer = b.layer AND a.key = b.key AND a.seq < b.seq GROUP BY b.seq),
      walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL
        SELECT clash.k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, clash.seq) ELSE gone END FROM walk JOIN clash ON clash.k = walk.k + 1),
      gone AS (SELECT unnest(gone) AS seq FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
      why AS (SELECT seq, layer, orig FROM (SELECT b.seq, b.layer, a.seq AS orig, row_number() OVER (PARTITION BY b.seq ORDER BY b.layer, a.seq) AS i FROM held a JOIN held b ON a.layer = b.layer AND a.key = b.key AND a.seq < b.seq
        WHERE b.seq IN (FROM gone) AND a.seq NOT IN (FROM gone)) WHERE i = 1),
      named AS (SELECT f.seq, f.url_key, f.seq = f.first AND w.seq IS NULL AS kept, CASE WHEN f.seq <> f.first THEN 1 ELSE w.layer END AS layer, CASE WHEN f.seq <> f.first THEN f.first ELSE w.orig END AS orig FROM firsts f LEFT JOIN why w ON f.seq = w.seq),
      found AS (SELECT n.*, o.url_key AS original_key FROM named n LEFT JOIN firsts o ON n.orig = o.seq)"""


REASON = "CASE layer WHEN 1 THEN 'duplicate_url' WHEN 2 THEN 'duplicate_content:exact_hash' WHEN 3 THEN 'duplicate_content:near_duplicate_of' WHEN 4 THEN 'duplicate_title_date' END"
DUP_TYPE = "CASE WHEN layer = 1 THEN 'url' WHEN layer = 2 THEN 'exact_content' WHEN layer IN (3, 4) THEN 'near_content' END"
NORM_TITLE = r"nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '^(.*) \| .*$', '\1')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '')"


def dedup_full() -> str:
    rows = f"""SELECT doc_id AS seq, 'https://x/' || doc_id AS url_key, text, {NORM_TITLE} || chr(31) || strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS td
      FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents)"""
    return f"WITH RECURSIVE {dedup_steps(rows)} SELECT seq, url_key, kept, {REASON} AS reason, {DUP_TYPE} AS dup_type, orig AS duplicate_of, original_key FROM found"


def done() -> str:
    """WITH RECURSIVE ... up to done: the pages as fetched queue rows, with their outcomes."""
    low, bare = "lower(coalesce(html, ''))", r"length(regexp_replace(coalesce(html, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'))"
    has = lambda names: "(" + " OR ".join(f"contains(low, '{w}')" for w in names) + ")"
    rows = f"SELECT id AS seq, url_key, main_text AS text, {NORM_TITLE} || chr(31) || publish_date AS td FROM reads JOIN ({normalize()}) n ON id = n.page_id WHERE good"
    return f"""WITH RECURSIVE items AS (SELECT page_id AS id, url, {NET} AS source_domain, CAST(page_id % 7 AS INTEGER) AS depth, CAST(page_id % 3 AS INTEGER) AS attempts, CASE WHEN page_id % 23 = 0 THEN 42.7::DOUBLE ELSE 0 END AS wait,
        page_id % 17 <> 0 AS allowed, CASE WHEN page_id % 29 = 0 THEN 403 WHEN page_id % 31 = 0 THEN 0 ELSE 200 END AS status, CASE WHEN page_id % 31 <> 0 THEN html END AS html, CASE WHEN page_id % 31 = 0 THEN 'timeout' END AS fetch_error, page_id % 37 <> 0 AS can_save FROM pages),
      looked AS (SELECT *, wait <= 10 AND allowed AS fetched, CASE WHEN status = 403 THEN 'forbidden_403' WHEN {has(blocks.WALL_PHRASES)} THEN 'bot_wall' WHEN n < 2000 AND {has(blocks.CAPTCHA.split("|"))} THEN 'captcha'
        WHEN n < 2000 AND {has(blocks.BLOCK_PHRASES)} THEN 'access_denied' WHEN status = 200 AND n < 300 THEN 'suspicious_empty_body' END AS b FROM (SELECT *, {low} AS low, {bare} AS n FROM items)),
      judged AS (SELECT *, CASE WHEN fetched THEN b IS NOT NULL AND (html IS NOT NULL OR status = 403) END AS blocked FROM looked),
      reads AS (SELECT j.*, fetched AND NOT blocked AND html IS NOT NULL AS has_page, CASE WHEN fetched THEN CASE WHEN blocked THEN b ELSE fetch_error END END AS block_reason, c.page_type, c.reason AS type_reason,
          x.canonical_url, x.title, x.author, x.publish_date, x.language, x.summary, x.main_text, x.content_type, x.quality_score,
          fetched AND NOT blocked AND html IS NOT NULL AND page_type = 'article' AND x.main_text IS NOT NULL AND x.quality_score >= 0.25 AS good
        FROM judged j JOIN ({classify()}) c ON j.id = c.page_id JOIN ({extracted()}) x ON j.id = x.page_id),
      {dedup_steps(rows)},
      done AS (SELECT *, CASE WHEN wait > 10 OR NOT allowed THEN 'skipped' WHEN NOT has_page THEN 'blocked' WHEN page_type <> 'article' THEN 'skipped' WHEN NOT good THEN 'low_quality' WHEN dup_reason IS NOT NULL THEN 'duplicate' WHEN can_save THEN 'saved' ELSE 'error' END AS outcome,
          CASE WHEN wait > 10 THEN 'domain_backoff' WHEN NOT allowed THEN 'robots_txt' WHEN NOT has_page THEN block_reason WHEN page_type <> 'article' THEN 'classifier:' || type_reason WHEN NOT good THEN 'low_quality' WHEN dup_reason IS NOT NULL THEN 'duplicate:' || dup_reason
            WHEN NOT can_save THEN 'save_failed' END AS why
        FROM (SELECT reads.*, f.url_key, f.original_key, {DUP_TYPE} AS dup_type, {REASON} || ':' || CASE WHEN layer = 2 THEN substr(sha256(main_text), 1, 12) ELSE f.original_key END AS dup_reason FROM reads LEFT JOIN found f ON id = f.seq))
      """


def outcomes() -> dict[str, str]:
    failed = "outcome IN ('blocked', 'error')"
    backoff = "30 * CAST(1 << attempts AS BIGINT)"
    js = lambda **kw: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in kw.items()) + " || '}'"
    s = lambda c: f"'\"' || {c} || '\"'"
    n = lambda c: f"CAST({c} AS VARCHAR)"
    last = f"""CASE WHEN why = 'domain_backoff' THEN {js(reason=s("why"), wait_seconds=n("round(wait, 1)"))} WHEN outcome = 'skipped' THEN {js(reason=s("regexp_replace(why, '^classifier:', '')"))}
      WHEN outcome = 'blocked' THEN {js(block_reason=s("block_reason"), attempt=n("attempts + 1"), next_backoff=n(backoff))} WHEN outcome = 'low_quality' THEN {js(quality_score=n("CASE WHEN main_text IS NOT NULL THEN quality_score ELSE 0.0::DOUBLE END"))}
      WHEN outcome = 'duplicate' THEN {js(dup_type=s("dup_type"), reason=s("dup_reason"))} WHEN outcome = 'saved' THEN {js(quality_score=n("quality_score"), language=s("language"))} ELSE {js(error=s("why"))} END"""
    counts = lambda c, where: f"""(SELECT '{{' || coalesce(string_agg('"' || k || '":' || n, ',' ORDER BY k), '') || '}}' FROM (SELECT {c} AS k, count(*) AS n FROM done WHERE {where} AND {c} IS NOT NULL GROUP BY 1))"""
    share = lambda a, b: f"printf('%.1f%%', ({a}) * 100.0::DOUBLE / greatest({b}, 1))"
    return {
        "page_outcomes": done() + "SELECT id, url, outcome, why, dup_type, CASE WHEN has_page AND page_type = 'article' THEN quality_score END AS quality_score FROM done",
        "outcome_queue": done() + f"""SELECT id, CASE WHEN why = 'domain_backoff' THEN 'pending' WHEN {failed} THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN outcome IN ('skipped', 'low_quality') THEN 'skipped' ELSE 'done' END AS status,
          CASE WHEN {failed} THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN coalesce(why, '') <> 'domain_backoff' THEN why END AS last_error, CASE WHEN why = 'domain_backoff' THEN CAST(floor(wait) AS BIGINT) + 1 WHEN {failed} THEN {backoff} END AS defer_seconds FROM done""",
        "outcome_events": done() + f"""SELECT id, 0 AS n, 'fetch_started' AS event_type, url, source_domain, CAST(NULL AS INTEGER) AS status_code, '{{}}' AS details FROM done WHERE fetched UNION ALL
          SELECT id, CASE WHEN fetched THEN 1 ELSE 0 END, CASE WHEN why = 'domain_backoff' THEN 'retry_scheduled' WHEN outcome = 'skipped' THEN 'classified_skip' WHEN outcome = 'blocked' THEN CASE WHEN blocked THEN 'blocked' ELSE 'fetch_failed' END ELSE outcome END, url, source_domain,
          CASE WHEN outcome = 'blocked' THEN status END, {last} FROM done""",
        "outcome_duplicates": done() + f"""SELECT url, canonical_url, source_domain, dup_type, original_key AS duplicate_of, regexp_extract(dup_reason, '([^:]*)$', 1) AS duplicate_of_compat, {js(reason=s("dup_reason"))} AS details FROM done WHERE outcome = 'duplicate'""",
        "outcome_articles": done() + "SELECT CAST(id AS VARCHAR) AS id, url, source_domain, canonical_url, title, author, publish_date, language, summary, main_text, quality_score, content_type FROM done WHERE outcome = 'saved'",
        "crawl_summary": done() + f"""SELECT *, {share("greatest(total_fetched, 1) - total_blocked", "total_fetched")} AS success_rate, {share("total_blocked", "total_fetched")} AS block_rate, {share("duplicates_removed", "articles_extracted + duplicates_removed")} AS duplicate_rate,
          {counts("block_reason", "blocked")} AS block_reasons, {counts("split_part(dup_reason, ':', 1)", "outcome = 'duplicate'")} AS dupe_breakdown FROM (
          SELECT count(DISTINCT source_domain) FILTER (WHERE fetched) AS domains_crawled, count(*) FILTER (WHERE fetched) AS total_fetched, count(*) FILTER (WHERE blocked) AS total_blocked, count(*) FILTER (WHERE outcome = 'skipped' AND why <> 'domain_backoff') AS skipped_by_classifier,
            count(*) FILTER (WHERE outcome = 'saved') AS articles_extracted, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates_removed, count(*) FILTER (WHERE outcome = 'low_quality') AS low_quality_dropped, round(coalesce(avg(quality_score) FILTER (WHERE outcome = 'saved'), 0), 3) AS avg_quality_score,
            count(*) FILTER (WHERE outcome = 'saved' AND quality_score > 0.7) AS high, count(*) FILTER (WHERE outcome = 'saved' AND quality_score BETWEEN 0.4 AND 0.7) AS medium, count(*) FILTER (WHERE outcome = 'saved' AND quality_score < 0.4) AS low FROM done)""",
        "link_enqueue": done().rstrip() + f""", lk AS (SELECT row_number() OVER () AS page_id, d.id AS seq, d.url AS discovered_from, d.depth + 1 AS depth, l.pos, l.link AS url FROM done d JOIN ({PAGE_LINKS}) l ON d.id = l.page_id WHERE d.outcome = 'saved' AND d.depth < 5),
          known AS (SELECT url_key, min(id) AS since FROM done WHERE url_key IS NOT NULL GROUP BY url_key),
          got AS (SELECT lk.* FROM lk JOIN ({normalize("lk")}) n USING (page_id) LEFT JOIN known k ON n.url_key = k.url_key WHERE lk.page_id IN ({candidates("lk")}) AND (since IS NULL OR since > seq))
          SELECT url, depth, discovered_from, pos, row_number() OVER (PARTITION BY url ORDER BY seq, pos) = 1 AS inserted FROM got""",
    }


def seed_queue() -> str:
    return f"""SELECT domain, CAST(i - 1 AS INTEGER) AS pos, url, 'https://' || domain || '/feed' AS source FROM (SELECT {NET} AS domain, url, row_number() OVER (PARTITION BY {NET} ORDER BY page_id) AS i FROM pages WHERE {NET} <> '' AND page_id IN ({candidates("pages")})) WHERE i <= 40"""
