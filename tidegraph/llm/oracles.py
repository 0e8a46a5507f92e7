"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tidegraph.llm.rules import STOP_WORDS

_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(0, 5) AS x(k) WHERE n > 1 GROUP BY r),
good AS (SELECT r, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own FROM w),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(own) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(ws, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({_LIST}))) AS n_stop
  FROM w LEFT JOIN rep USING (r) JOIN good USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols <= 0.25 * n_words AND n_bangs <= 0.25 * n_words AND n_upper <= 0.5 * n_letters
    AND word_chars >= 1.5 * n_words AND word_chars <= 40 * n_words AND n_dup_lines <= 0.5 * n_lines
    AND (n_stop >= 0.02 * n_words OR n_words < 50) AS kept
FROM b
"""

OP4 = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 90) AS x(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT *, (('0x' || substr(md5('7|' || doc_id || '|1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n_copies FROM u JOIN c ON u.source = c.source AND c.c <= u.u GROUP BY ALL),
e AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, n_copies::BIGINT AS n_copies, copy::BIGINT AS copy,
  ('0x' || substr(md5('order7|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM e
"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id
"""

ORACLES = {"op3_quality_rules": OP3, "op4_poisson_mix": OP4, "op9_bayes_jaccard": OP9}
