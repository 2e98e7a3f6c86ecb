"""SQL for the queries that it can express, as DuckDB runs it."""

from __future__ import annotations

from quire.llm import quality

_RULES = {k: list(v) for k, v in quality.GRID.items()}
_TESTS = sum(map(len, _RULES.values()))
_SHARE = quality.ALPHA / len(_RULES)
_NAMES = ", ".join(_RULES)
_CUTS = ", ".join(f"('{k}', {c}::DOUBLE)" for k, cuts in _RULES.items() for c in cuts)

#: The generated pages hold one article of plain elements and these character references.
OP2 = r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(b|i|em|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS text FROM c)
    SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

OP3 = rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (
        SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
            [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
        FROM d),
    wins AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    marked AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM marked) GROUP BY doc_id),
    m AS (
        SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
        FROM w LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
    v AS (
        SELECT *, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
            n_repeat_words / nullif(n_words, 0) AS repeat_ratio, word_chars / nullif(n_words, 0) AS long_words, -word_chars / nullif(n_words, 0) AS short_words
        FROM f),
    held AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    grid AS (SELECT * FROM (VALUES {_CUTS}) g(rule, cut)),
    lv AS (UNPIVOT (SELECT doc_id, lang, {_NAMES} FROM held) ON {_NAMES} INTO NAME rule VALUE x),
    n AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
    tested AS (SELECT lang, rule, cut, count(*) FILTER (x > cut) AS k FROM lv JOIN grid USING (rule) GROUP BY lang, rule, cut),
    tails AS (
        SELECT lang, rule, cut, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln({1 - _SHARE}))) AS p
        FROM (SELECT lang, rule, cut, n, unnest(range(0, k + 1)) AS i FROM tested JOIN n USING (lang) WHERE k <= n * {_SHARE}) GROUP BY lang, rule, cut),
    chosen AS (SELECT lang, rule, min(cut) AS cut FROM tails WHERE p <= {quality.DELTA} / ({_TESTS} * (SELECT count(*) FROM n)) GROUP BY lang, rule),
    lw AS (UNPIVOT (SELECT doc_id, lang, {_NAMES} FROM v) ON {_NAMES} INTO NAME rule VALUE x),
    broken AS (SELECT DISTINCT doc_id FROM lw JOIN chosen USING (lang, rule) WHERE x > cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
    FROM v
"""

OP6 = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    lowest AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lowest ON lowest.a = w.doc_id
"""
