"""The ten registered queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from tessera.llm.bpe import op8_bpe
from tessera.llm.langid import op4_langid
from tessera.llm.lm import op9_lm
from tessera.llm.packing import op1_packing
from tessera.llm.pii import op5_pii
from tessera.llm.quality import BOILERPLATE, NAVIGATION, SYMBOLS, QualityRules, op10_quality
from tessera.llm.simhash import op3_simhash
from tessera.llm.substring import op6_substring
from tessera.llm.topk import op2_topk
from tessera.llm.urls import LISTED_LABELS, RULES, op7_urls

QUERIES = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_langid": op4_langid,
    "op5_pii": op5_pii,
    "op6_substring": op6_substring,
    "op7_urls": op7_urls,
    "op8_bpe": op8_bpe,
    "op9_lm": op9_lm,
    "op10_quality": op10_quality,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM k),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM win SEMI JOIN twice USING (s)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_RULES = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in RULES)
_OP7 = f"""
WITH p AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(verdict, rule, rhost, rpath) AS (VALUES {_RULES}),
m AS (
  SELECT host, path, max_by(struct_pack(rule, verdict), length(rule)) AS b
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
), c AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':\\d+$', '') || regexp_replace(path, '/$', '') AS canonical FROM p
), l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), {list(LISTED_LABELS)}))
SELECT page_id, c.host, c.path, b.rule AS rule, coalesce(b.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM c LEFT JOIN m USING (host, path) LEFT JOIN l USING (canonical)
"""

_R = QualityRules()
_OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
named AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM named),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest(range(0, 3)) AS p FROM rep WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
fl AS (SELECT rid, line, trim(line, {_SPACE}) AS x FROM lines WHERE trim(line, {_SPACE}) <> ''),
judged AS (
  SELECT rid, line, x, length(x) AS n,
    length(x) - length(translate(x, '{SYMBOLS}', '')) AS symbols, length(x) - length(translate(x, '|»›•·', '')) AS bars
  FROM fl
),
good AS (
  SELECT *, NOT (
    (n <= {_R.max_chars_boilerplate} AND regexp_matches(x, '(?i){BOILERPLATE}'))
    OR bars * 100 > n * {_R.max_separators_percent}
    OR regexp_matches(x, '(?i)^(?:(?:{NAVIGATION})(?:[\\s|/>»›•·-]+|$))+$')
    OR (n < {_R.min_chars_unmarked} AND NOT regexp_matches(x, '[.!?…。！？؟।:;]'))
    OR symbols * 100 > n * {_R.max_symbol_percent}
  ) AS ok FROM judged
),
per AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_different, count(*) FILTER (NOT ok) AS n_bad,
    coalesce(sum(length(translate(line, {_SPACE}, ''))) FILTER (ok), 0) AS left_chars
  FROM good GROUP BY rid
),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(text, {_SPACE}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(n_lines - n_different, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_lines_removed, coalesce(left_chars, 0) AS left_chars
  FROM d LEFT JOIN per USING (rid) LEFT JOIN covered USING (rid)
),
failed AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (word_chars - left_chars) * 100 <= {_R.max_lost_percent} * word_chars AS kept, n_lines, n_lines_removed
FROM failed
"""

ORACLES = {"op2_topk": _OP2, "op6_substring": _OP6, "op7_urls": _OP7, "op10_quality": _OP10}
