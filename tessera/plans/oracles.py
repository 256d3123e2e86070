"""DuckDB SQL for the retrieval queries, composed from named steps and written apart from the Spark plans."""

from __future__ import annotations

import re

from tessera.functions.stemmer import DUCKDB, Rules
from tessera.functions.text import ACCENTED, FINANCE_FILING, FINANCE_KEEP, FINANCE_NUMBER, FINANCE_PERIOD, FINANCE_TICKER, NEGATORS, NUMERIC_CLAIM, PLAIN, SEVERAL, STOPWORDS
from tessera.operators.chunking import ABBREVIATIONS
from tessera.operators.chunking import mark_of as _mark

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS if "'" not in w and w not in NEGATORS)
_STOP_FINANCE = ", ".join(f"'{w}'" for w in STOPWORDS if "'" not in w and w not in NEGATORS and w not in FINANCE_KEEP)


def _norm(t: str, kept: str = r"[^\p{L}\p{N}_]+") -> str:
    folded = f"lower({t})"
    for letter, letters in SEVERAL:
        folded = f"replace({folded}, '{letter}', '{letters}')"
    return f"trim(regexp_replace(translate({folded}, '{ACCENTED}', '{PLAIN}'), '{kept}', ' ', 'g'))"


_FIN = r"[^\p{L}\p{N}_$%/-]+"


def _sents(t: str) -> str:
    cut = rf"string_split(regexp_replace(trim({t}, {_BLANK}), '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x, {_BLANK})), lambda x: x <> '')"


def _toks(t: str, stop: str = _STOP, kept: str = r"[^\p{L}\p{N}_]+") -> str:
    return f"list_filter(string_split({_norm(t, kept)}, ' '), lambda x: x <> '' AND x NOT IN ({stop}))"


def _count(t: str) -> str:
    return f"len(list_filter(string_split({_norm(t)}, ' '), lambda x: x <> ''))"


STEPS = {
    "docs": f"SELECT doc_id::VARCHAR AS doc_id, coalesce({_sents('text')}[1][1:200], '') AS title, text, lang, source FROM documents WHERE text IS NOT NULL",
    "split": f"SELECT *, {_sents('text')} AS s FROM docs",
    "spans": "SELECT *, unnest(range(0, greatest(0, ceil((len(s) - 3) / 2.0)::INT) + 1)) AS k FROM split WHERE len(s) > 0",
    "chunks": f"SELECT doc_id || '#' || k AS chunk_id, doc_id, title, array_to_string(s[2 * k + 1 : least(len(s), 2 * k + 3)], ' ') AS text, 2 * k AS a, least(len(s), 2 * k + 3) AS b, lang, source FROM spans UNION ALL SELECT doc_id || '#0', doc_id, title, text, 0, 0, lang, source FROM split WHERE len(s) = 0",
    "zones": "SELECT chunk_id, 0 AS gap, title AS t FROM chunks UNION ALL SELECT chunk_id, 1000, text FROM chunks",
    "zt": f"SELECT chunk_id, gap, {_toks('t')} AS w FROM zones",
    "occ": "SELECT chunk_id, unnest(range(0, len(w))) + gap AS p, unnest(w) AS token FROM zt",
    "qs": "SELECT item_id::VARCHAR AS qid, text FROM benchmark",
    "qw": f"SELECT qid, {_toks('text')} AS w FROM qs",
    "qtok": "SELECT qid, unnest(w) AS token FROM qw",
    "vocab": "SELECT DISTINCT token FROM (SELECT token FROM occ UNION ALL SELECT token FROM qtok)",
    "stems": Rules(DUCKDB).query("vocab"),
    "postings": "SELECT stem AS term, chunk_id, count(*) AS tf, count(*) FILTER (p < 1000) AS tf_title, list(p ORDER BY p) AS ps FROM occ JOIN stems USING (token) GROUP BY ALL",
    "n": "SELECT count(DISTINCT chunk_id) AS n FROM postings",
    "terms": "SELECT term, count(*) AS df, ln(any_value(n) / count(*)) AS idf, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS bm25_idf FROM postings, n GROUP BY term",
    "stats": "SELECT chunk_id, sum(tf)::BIGINT AS length, sum(tf_title)::BIGINT AS title_length, sqrt(sum((1 + ln(tf + tf_title)) ** 2)) AS norm, 0.5 * coalesce(avg(idf) FILTER (tf > tf_title), 0) / ln(any_value(n)) + 0.5 * coalesce(avg(idf) FILTER (tf_title > 0), 0) / ln(any_value(n)) AS g FROM postings JOIN terms USING (term), n GROUP BY chunk_id",
    "champs": "SELECT term, chunk_id, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN idf > 0 THEN round(ln(tf + tf_title), 9) ELSE 0 END DESC, chunk_id) AS rnk FROM postings JOIN terms USING (term) QUALIFY rnk <= 50",
    "qt": "SELECT qid, stem AS term, count(*) AS f FROM qtok JOIN stems USING (token) GROUP BY ALL",
    "qraw": "SELECT qid, term, df, idf, bm25_idf, CASE WHEN idf > 0 THEN (1 + ln(f)) * idf ELSE 0 END AS w FROM qt JOIN terms USING (term)",
    "qvec": "SELECT *, CASE WHEN sum(w * w) OVER (PARTITION BY qid) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY qid)) ELSE 0 END AS qw FROM qraw",
    "tfidf": "SELECT qid, chunk_id, sum(qw * (1 + ln(tf + tf_title)) / norm) AS base, count(*) AS matched FROM qvec JOIN postings USING (term) JOIN stats USING (chunk_id) GROUP BY ALL",
    "top": "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9) DESC, chunk_id) AS rank, chunk_id, base AS score FROM tfidf QUALIFY rank <= 10",
    "bm": "SELECT qid, chunk_id, sum(qw * bm25_idf * (tf + tf_title) * 2.5 / (tf + tf_title + 1.5 * (0.25 + 0.75 * length / al))) AS base FROM qvec JOIN postings USING (term) JOIN stats USING (chunk_id), (SELECT avg(length) AS al FROM stats) GROUP BY ALL",
    "held": "SELECT qid, term, chunk_id, ps FROM qvec JOIN postings USING (term)",
    "near": "SELECT x.qid, x.chunk_id, count(*) AS close FROM held x JOIN held y ON x.qid = y.qid AND x.chunk_id = y.chunk_id AND x.term < y.term WHERE len(list_filter(x.ps, lambda i: len(list_filter(y.ps, lambda j: abs(i - j) <= 30)) > 0)) > 0 GROUP BY ALL",
    "used": "SELECT qid, count(*) AS u FROM qvec GROUP BY qid",
    "prox": "SELECT t.qid, t.chunk_id, base * (1 + 0.5 * coalesce(close / (u * (u - 1) / 2), 0)) AS score FROM tfidf t JOIN used USING (qid) LEFT JOIN near USING (qid, chunk_id)",
    "toprox": "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id, score FROM prox QUALIFY rank <= 10",
    "pairs": "SELECT qid AS cid, chunk_id, rank FROM top WHERE rank <= 5",
    "cv": "SELECT qid AS cid, term, idf, qw FROM qvec WHERE idf > 0",
    "cs": "SELECT cid, p.chunk_id, least(1, coalesce(sum(qw * (1 + ln(tf + tf_title)) / norm), 0)) AS cosine, coalesce(sum(idf) FILTER (tf IS NULL), 0) / sum(idf) AS penalty, coalesce(string_agg(c.term, ' ' ORDER BY c.term) FILTER (tf IS NULL), '') AS novel FROM pairs p JOIN cv c USING (cid) LEFT JOIN postings o ON o.term = c.term AND o.chunk_id = p.chunk_id LEFT JOIN stats s ON s.chunk_id = p.chunk_id GROUP BY ALL",
    "rels": "SELECT qid, doc_id FROM docs, qs WHERE contains(docs.text, qs.text)",
    "rank100": "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9) DESC, chunk_id) AS rank, chunk_id FROM tfidf QUALIFY rank <= 100",
    "parents": "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM rank100 JOIN chunks USING (chunk_id) GROUP BY qid, doc_id",
    "hits": "SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) AS h FROM parents JOIN rels USING (qid, doc_id)",
    "per": "SELECT qid, sum(1 / log2(rank + 1)) FILTER (rank <= 10) / sum(1 / log2(h + 1)) FILTER (rank <= 10) AS ndcg, count(*) FILTER (rank <= 5) / 5 AS p5, count(*) FILTER (rank <= 10) / 10 AS p10, count(*) FILTER (rank <= 100) AS h100, 1 / min(rank) AS mrr, sum(h / rank) AS cum FROM hits GROUP BY qid",
    "total": "SELECT qid, count(DISTINCT doc_id) AS total FROM rels GROUP BY qid",
}


def _replaced(t: str, back: bool = False) -> str:
    for i, a in enumerate(ABBREVIATIONS):
        old, new = (_mark(i), a) if back else (a, _mark(i))
        t = f"replace({t}, '{old}', '{new}')"
    return t


def _is_table(x: str) -> str:
    return rf"(contains({x}, '|') OR (contains({x}, '$') AND regexp_matches({x}, '(?i)(\|.*\|)|(\$?\s*[0-9][0-9,.]*\s*(B|M|%|million|billion))')))"


_FIN_LINES = f"list_filter(list_transform(string_split({_replaced('text')}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
_GRID = ", ".join(f"({i}, {a}::DOUBLE, {w}, {e}::DOUBLE)" for i, (a, w, e) in enumerate((a, w, e) for a in (0, 0.5, 1) for w in ((10,) if a == 0 else (10, 30)) for e in (0, 0.1)))
_NEAR = "SELECT x.qid, x.chunk_id, {w} AS win, count(*) AS close FROM held x JOIN held y ON x.qid = y.qid AND x.chunk_id = y.chunk_id AND x.term < y.term WHERE len(list_filter(x.ps, lambda i: len(list_filter(y.ps, lambda j: abs(i - j) <= {w})) > 0)) > 0 GROUP BY ALL"
STEPS |= {
    "finsplit": f"SELECT *, list_transform(flatten(list_transform({_FIN_LINES}, lambda l: CASE WHEN {_is_table('l')} THEN [l] ELSE {_sents('l')} END)), lambda l: {_replaced('l', True)}) AS s FROM docs",
    "finspans": "SELECT *, unnest(range(0, greatest(0, ceil((len(s) - 3) / 2.0)::INT) + 1)) AS k FROM finsplit WHERE len(s) > 0",
    "finchunks": "SELECT doc_id || '#' || k AS chunk_id, array_to_string(s[2 * k + 1 : least(len(s), 2 * k + 3)], ' ') AS text, 2 * k AS a, least(len(s), 2 * k + 3) AS b, true AS fin FROM finspans UNION ALL SELECT doc_id || '#0', text, 0, 0, false FROM finsplit WHERE len(s) = 0",
    "ss": f"SELECT qid, rank, chunk_id, unnest(range(0, len(s))) AS n, unnest(s) AS text FROM (SELECT qid, rank, chunk_id, {_sents('text')} AS s FROM toprox JOIN chunks USING (chunk_id) WHERE rank <= 5)",
    "st": f"SELECT qid, rank, n, unnest(w) AS token FROM (SELECT qid, rank, n, {_toks('text')} AS w FROM ss)",
    "sterms": "SELECT qid, rank, n, stem AS term, count(*) AS f FROM st JOIN stems USING (token) GROUP BY ALL",
    "slong": "SELECT qid, rank, n FROM sterms GROUP BY ALL HAVING sum(f) >= 4",
    "sw": "SELECT qid, rank, n, term, CASE WHEN idf > 0 THEN (1 + ln(f)) * idf ELSE 0 END AS w FROM sterms JOIN terms USING (term)",
    "sv": "SELECT qid, rank, n, term, CASE WHEN sum(w * w) OVER (PARTITION BY qid, rank, n) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY qid, rank, n)) ELSE 0 END AS qw FROM sw",
    "srel": "SELECT v.qid, v.rank, v.n, least(1, sum(v.qw * q.qw)) AS rel FROM sv v JOIN qvec q ON v.qid = q.qid AND v.term = q.term GROUP BY ALL",
    "cand": "SELECT qid, rank, n, chunk_id, text, round(rel, 4) AS relevance FROM ss SEMI JOIN slong USING (qid, rank, n) JOIN srel USING (qid, rank, n) WHERE rel >= 0.02",
    "m1": "SELECT *, 1 AS turn FROM cand QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * relevance, 9) DESC, rank, n) = 1",
    "c1": "SELECT v.qid, v.rank, v.n, least(1, sum(v.qw * x.qw)) AS cos FROM sv v JOIN sv x ON v.qid = x.qid AND v.term = x.term SEMI JOIN m1 ON x.qid = m1.qid AND x.rank = m1.rank AND x.n = m1.n GROUP BY ALL",
    "l1": "SELECT d.*, greatest(0, coalesce(cos, 0)) AS near FROM cand d ANTI JOIN m1 USING (qid, rank, n) LEFT JOIN c1 USING (qid, rank, n)",
    "m2": "SELECT * EXCLUDE (near), 2 AS turn FROM l1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * relevance - 0.3 * near, 9) DESC, rank, n) = 1",
    "c2": "SELECT v.qid, v.rank, v.n, least(1, sum(v.qw * x.qw)) AS cos FROM sv v JOIN sv x ON v.qid = x.qid AND v.term = x.term SEMI JOIN m2 ON x.qid = m2.qid AND x.rank = m2.rank AND x.n = m2.n GROUP BY ALL",
    "l2": "SELECT d.* EXCLUDE (near), greatest(near, coalesce(cos, 0)) AS near FROM l1 d ANTI JOIN m2 USING (qid, rank, n) LEFT JOIN c2 USING (qid, rank, n)",
    "m3": "SELECT * EXCLUDE (near), 3 AS turn FROM l2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.7 * relevance - 0.3 * near, 9) DESC, rank, n) = 1",
    "items": "SELECT qid, text AS claim, doc_id, CASE WHEN doc_id IS NULL THEN 'NEI' WHEN qid::BIGINT % 2 = 0 THEN 'SUPPORT' ELSE 'CONTRADICT' END AS label FROM qs LEFT JOIN (SELECT DISTINCT qid, doc_id FROM rels) USING (qid)",
    "ip": "SELECT i.qid, i.doc_id, i.doc_id AS grp, c.chunk_id, a AS o FROM items i JOIN chunks c ON i.doc_id = c.doc_id SEMI JOIN stats s ON c.chunk_id = s.chunk_id UNION ALL SELECT i.qid, i.doc_id, t.chunk_id, t.chunk_id, t.rank FROM items i JOIN toprox t ON i.qid = t.qid WHERE i.doc_id IS NULL AND t.rank <= 5",
    "ics": "SELECT p.qid, p.chunk_id, least(1, coalesce(sum(qw * (1 + ln(tf + tf_title)) / norm), 0)) AS cosine, coalesce(sum(idf) FILTER (tf IS NULL), 0) / sum(idf) AS penalty FROM (SELECT DISTINCT qid, chunk_id FROM ip) p JOIN (SELECT qid, term, idf, qw FROM qvec WHERE idf > 0) c ON c.qid = p.qid LEFT JOIN postings o ON o.term = c.term AND o.chunk_id = p.chunk_id LEFT JOIN stats s ON s.chunk_id = p.chunk_id GROUP BY ALL",
    "ibest": "SELECT ip.qid, ip.doc_id, coalesce(cosine, 0) AS cosine, coalesce(penalty, 0) AS penalty FROM ip LEFT JOIN ics ON ip.qid = ics.qid AND ip.chunk_id = ics.chunk_id QUALIFY row_number() OVER (PARTITION BY ip.qid, ip.doc_id ORDER BY round(coalesce(cosine, 0), 9) DESC, o) = 1",
    "mine": "SELECT DISTINCT qid, term FROM qt",
    "ibody": "SELECT DISTINCT qid, doc_id, grp, term FROM ip JOIN postings USING (chunk_id) WHERE tf > tf_title",
    "iover": "SELECT b.qid, b.doc_id, b.grp, count(*) AS nb, count(m.term) AS ni FROM ibody b LEFT JOIN mine m ON b.qid = m.qid AND b.term = m.term GROUP BY ALL",
    "ijac": "SELECT qid, doc_id, max(ni / (na + nb - ni)) AS jaccard FROM iover JOIN (SELECT qid, count(*) AS na FROM mine GROUP BY qid) USING (qid) GROUP BY ALL",
    "iscores": "SELECT i.qid, i.doc_id, label, label = 'SUPPORT' AS gold, coalesce(cosine, 0) AS cosine, CASE WHEN i.doc_id IS NULL AND coalesce(cosine, 0) <= 0 THEN 0 ELSE coalesce(penalty, 0) END AS penalty, coalesce(jaccard, 0) AS jaccard FROM items i LEFT JOIN ibest b ON i.qid = b.qid AND i.doc_id IS NOT DISTINCT FROM b.doc_id LEFT JOIN ijac j ON i.qid = j.qid AND i.doc_id IS NOT DISTINCT FROM j.doc_id",
    "near2": f"{_NEAR.format(w=10)} UNION ALL {_NEAR.format(w=30)}",
    "grid": f"SELECT * FROM (VALUES {_GRID}) g(point, weight, win, eta)",
    "gs": "SELECT point, t.qid, t.chunk_id, base * (1 + weight * coalesce(close / (u * (u - 1) / 2), 0)) + eta * g AS score FROM tfidf t JOIN used ON t.qid = used.qid JOIN stats s ON t.chunk_id = s.chunk_id CROSS JOIN grid LEFT JOIN near2 x ON x.qid = t.qid AND x.chunk_id = t.chunk_id AND x.win = grid.win",
    "gtop": "SELECT point, qid, chunk_id, row_number() OVER (PARTITION BY point, qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM gs QUALIFY rank <= 20",
    "gparents": "SELECT point, qid, doc_id, row_number() OVER (PARTITION BY point, qid ORDER BY min(rank)) AS rank FROM gtop JOIN chunks USING (chunk_id) GROUP BY point, qid, doc_id",
    "ghits": "SELECT point, qid, rank, count(*) OVER (PARTITION BY point, qid ORDER BY rank) AS h FROM gparents JOIN rels USING (qid, doc_id)",
    "gper": "SELECT point, qid, sum(1 / log2(rank + 1)) FILTER (rank <= 10) / sum(1 / log2(h + 1)) FILTER (rank <= 10) AS ndcg FROM ghits GROUP BY ALL",
}


def sql(select: str) -> str:
    """select with the steps it needs before it, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in STEPS:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                add(STEPS[name])

    add(select)
    # a step of several readers is kept, not inlined
    steps = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in STEPS.items() if name in need)
    return f"WITH {steps}\n{select}"


def _ranked(step: str) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9) DESC, chunk_id) AS rank, chunk_id, round(base, 6) AS score FROM {step} QUALIFY rank <= 10"


def _leaf(stem_of: str, where: str = "true") -> str:
    return f"SELECT chunk_id FROM postings WHERE term = '{stem_of}' AND {where}"


_FLAGS = " OR ".join(f"regexp_matches(token, '{p}')" for p in (FINANCE_NUMBER, FINANCE_TICKER, FINANCE_PERIOD, FINANCE_FILING))
_VERDICT = "CASE WHEN round(support, 9) >= 0.2 THEN 'SUPPORTED' WHEN round(support, 9) >= 0.12 THEN 'WEAK' ELSE 'UNSUPPORTED' END"
ORACLES = {
    "normalize_text": sql(f"SELECT doc_id, {_norm('text')} AS norm FROM docs"),
    "normalize_finance": sql(f"SELECT doc_id, {_norm('text', _FIN)} AS norm FROM docs"),
    "tokenize": sql(f"SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, {_toks('text')} AS w FROM docs)"),
    "finance_token_flags": sql(f"SELECT token, ({_FLAGS}) AS finance, regexp_matches(token, '{NUMERIC_CLAIM}') AS number FROM (SELECT DISTINCT unnest({_toks('text', _STOP_FINANCE, _FIN)}) AS token FROM docs)"),
    "porter_stem": sql("SELECT token, stem FROM stems WHERE token IN (SELECT token FROM occ WHERE p >= 1000)"),
    "split_sentences": sql("SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM split"),
    "table_lines": sql(r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE contains(line, '|') OR (contains(line, '$') AND regexp_matches(line, '(?i)(\|.*\|)|(\$?\s*[0-9][0-9,.]*\s*(B|M|%|million|billion))')) GROUP BY doc_id"),
    "query_words": sql("SELECT qid, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 1))), ' ') AS words FROM qs"),
    "highlight": "SELECT item_id::VARCHAR AS qid, regexp_replace(text, '(?i)\\b(and|the)\\b', '<mark>\\1</mark>', 'g') AS marked FROM benchmark",
    "chunk_whole": sql(f"SELECT doc_id || '#0' AS chunk_id, text, 0::BIGINT AS sentence_start, 0::BIGINT AS sentence_end, {_count('text')}::BIGINT AS tokens FROM docs"),
    "chunk_sentence": sql(f"SELECT chunk_id, text, a::BIGINT AS sentence_start, b::BIGINT AS sentence_end, {_count('text')}::BIGINT AS tokens FROM chunks"),
    "build_postings": sql("SELECT term, chunk_id, tf, tf_title, array_to_string(ps, ',') AS positions FROM postings"),
    "term_idf": sql("SELECT term, df, round(idf, 6) AS idf, round(bm25_idf, 6) AS bm25_idf FROM terms"),
    "doc_norms": sql("SELECT chunk_id, length, title_length, round(norm, 6) AS norm FROM stats"),
    "static_quality": sql("SELECT chunk_id, round(g, 6) AS g FROM stats"),
    "corpus_stats": sql("SELECT count(*) AS n, round(avg(length), 6) AS avg_length FROM stats"),
    "champion_lists": sql("SELECT term, chunk_id, rnk FROM champs"),
    "skip_plan": sql("SELECT term, i, chunk_id FROM (SELECT term, chunk_id, df, row_number() OVER (PARTITION BY term ORDER BY chunk_id) - 1 AS i FROM postings JOIN terms USING (term) WHERE df >= 32) WHERE i >= floor(sqrt(df)) AND i % floor(sqrt(df))::BIGINT = 0"),
    "build_stats": sql(f"SELECT count(DISTINCT doc_id) AS docs, count(*) AS chunks, round(avg({_count('text')}), 1) AS avg_tokens, (SELECT count(*) FROM terms) AS terms FROM chunks"),
    "query_vector": sql("SELECT qid, term, round(qw, 6) AS qw FROM qvec"),
    "index_elimination": sql("SELECT qid, term, CASE WHEN df IS NULL THEN 'not in dictionary' ELSE 'df=' || df || ' exceeds threshold' END AS reason FROM qt LEFT JOIN terms USING (term), n WHERE df IS NULL OR df / n > 0.05"),
    "explain_terms": sql("SELECT qid, term, df, round(idf, 6) AS idf, round(qw, 6) AS query_weight, df AS postings_processed FROM qvec"),
    "match_count": sql("SELECT qid, chunk_id, count(*) AS n FROM qt JOIN postings USING (term) GROUP BY ALL"),
    "search_tfidf": sql("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM top"),
    "search_bm25": sql(_ranked("bm")),
    "search_champions": sql(_ranked("(SELECT qid, chunk_id, sum(qw * (1 + ln(tf + tf_title)) / norm) AS base FROM qvec JOIN postings USING (term) SEMI JOIN champs USING (term, chunk_id) JOIN stats USING (chunk_id) GROUP BY ALL)")),
    "search_proximity": sql("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM toprox"),
    "search_full": sql(_ranked("(SELECT qid, chunk_id, score + 0.1 * g AS base FROM prox JOIN stats USING (chunk_id))")),
    "parent_ranking": sql("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank, doc_id FROM top JOIN chunks USING (chunk_id) GROUP BY qid, doc_id"),
    "bool_term": sql(_leaf("theand")),
    "bool_and": sql(f"{_leaf('ererin')} INTERSECT {_leaf('onin')}"),
    "bool_or": sql(f"{_leaf('ererin')} UNION {_leaf('onin')}"),
    "bool_not": sql(f"SELECT chunk_id FROM stats EXCEPT {_leaf('onin')}"),
    "bool_phrase": sql("SELECT a.chunk_id FROM (SELECT chunk_id, unnest(ps) AS p FROM postings WHERE term = 'onin') a JOIN (SELECT chunk_id, unnest(ps) AS p FROM postings WHERE term = 'thnt') b ON a.chunk_id = b.chunk_id AND b.p = a.p + 1 GROUP BY a.chunk_id"),
    "bool_zone": sql(_leaf("onin", "tf_title > 0")),
    "bool_meta": sql("SELECT chunk_id FROM chunks SEMI JOIN stats USING (chunk_id) WHERE lower(lang) = 'de' AND lower(source) = 'src0'"),
    "bool_complex": sql(f"({_leaf('onin', 'tf_title > 0')} UNION {_leaf('ererin', 'tf_title < tf')}) EXCEPT SELECT chunk_id FROM chunks WHERE lower(lang) = 'fr'"),
    "claim_cosine": sql("SELECT cid, chunk_id, round(cosine, 6) AS cosine, round(penalty, 6) AS penalty, novel FROM cs"),
    "verify_claims": sql(f"SELECT cid, chunk_id, round(support, 6) AS support, {_VERDICT} AS verdict FROM (SELECT cid, chunk_id, rank, greatest(0, least(1, cosine * (1 - least(1, 0.6 * penalty)))) AS support FROM cs JOIN pairs USING (cid, chunk_id)) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(support, 9) DESC, rank) = 1"),
    "eval_retrieval": sql("SELECT qid, round(coalesce(ndcg, 0), 6) AS ndcg, round(coalesce(p5, 0), 6) AS p5, round(coalesce(p10, 0), 6) AS p10, round(coalesce(h100 / total, 0), 6) AS r100, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(cum / total, 0), 6) AS ap FROM total LEFT JOIN per USING (qid)"),
    "eval_mean": sql("SELECT round(avg(ndcg), 6) AS ndcg, round(avg(p5), 6) AS p5, round(avg(p10), 6) AS p10, round(avg(r100), 6) AS r100, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap FROM (SELECT round(coalesce(ndcg, 0), 6) AS ndcg, round(coalesce(p5, 0), 6) AS p5, round(coalesce(p10, 0), 6) AS p10, round(coalesce(h100 / total, 0), 6) AS r100, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(cum / total, 0), 6) AS ap FROM total LEFT JOIN per USING (qid))"),
    "scan_corpus": "SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS title, text FROM documents WHERE text <> ''",
    "scan_queries": "SELECT item_id::VARCHAR AS qid, text, CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR END AS doc_id, CASE WHEN item_id % 2 = 0 THEN (item_id % 3)::VARCHAR END AS sentence, CASE WHEN item_id % 2 = 0 THEN 'SUPPORT' END AS label FROM benchmark",
    "scan_qrels": "SELECT quality::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, max(toxic)::BIGINT AS score FROM labels GROUP BY ALL",
    "ingest_docs": "SELECT item_id::VARCHAR AS _id, 'item ' || item_id AS title, text, 'UNKNOWN' AS ticker, 'none' AS company, '2024-Q1' AS period FROM benchmark WHERE text <> ''",
    "surrogate_id": sql("SELECT doc_id, 'FIN_' || upper(substring(sha1('folder/file.txt' || substring(text, 1, 200)), 1, 8)) AS id FROM docs"),
    "qrels": sql("SELECT qid, doc_id FROM rels"),
    "query_terms": sql("SELECT qid, pos, stem AS term FROM (SELECT qid, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM qw) JOIN stems USING (token)"),
    "describe_term": sql("""SELECT term, coalesce(df, 0) AS df, round(coalesce(idf, 0), 6) AS idf, coalesce(p, '') AS postings, coalesce(s, '') AS skips, coalesce(c, '') AS champions FROM (SELECT DISTINCT term FROM qt) LEFT JOIN terms USING (term)
LEFT JOIN (SELECT term, string_agg(chunk_id, ' ' ORDER BY chunk_id) AS p FROM (SELECT term, chunk_id FROM postings QUALIFY row_number() OVER (PARTITION BY term ORDER BY chunk_id) <= 8) GROUP BY term) USING (term)
LEFT JOIN (SELECT term, string_agg(chunk_id, ' ' ORDER BY i) AS s FROM (SELECT term, i, chunk_id FROM (SELECT term, chunk_id, df, row_number() OVER (PARTITION BY term ORDER BY chunk_id) - 1 AS i FROM postings JOIN terms USING (term) WHERE df >= 32) WHERE i >= floor(sqrt(df)) AND i % floor(sqrt(df))::BIGINT = 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY i) <= 8) GROUP BY term) USING (term)
LEFT JOIN (SELECT term, string_agg(chunk_id, ' ' ORDER BY rnk) AS c FROM champs WHERE rnk <= 8 GROUP BY term) USING (term)"""),
    "explain_contributions": sql("SELECT qid, chunk_id, term, round(qw * (1 + ln(tf + tf_title)) / norm, 6) AS w FROM qvec JOIN postings USING (term) JOIN stats USING (chunk_id) SEMI JOIN top USING (qid, chunk_id)"),
    "bool_zone_phrase": sql("SELECT a.chunk_id FROM (SELECT chunk_id, unnest(ps) AS p FROM postings WHERE term = 'onin') a JOIN (SELECT chunk_id, unnest(ps) AS p FROM postings WHERE term = 'thnt') b ON a.chunk_id = b.chunk_id AND b.p = a.p + 1 WHERE a.p >= 1000 GROUP BY a.chunk_id"),
    "bool_trace": sql(f"""SELECT step::BIGINT AS step, node, n::BIGINT AS n FROM (
SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS step,
  unnest(['ererin', 'onin', 'theand', 'OR', 'NOT', CASE WHEN a <= every THEN 'order ererin -> NOT' ELSE 'order NOT -> ererin' END, 'AND']) AS node,
  unnest([a, b, c, either, every - either, 2, common]) AS n
FROM (SELECT (SELECT count(*) FROM ({_leaf('ererin')})) AS a, (SELECT count(*) FROM ({_leaf('onin')})) AS b, (SELECT count(*) FROM ({_leaf('theand')})) AS c,
  (SELECT count(*) FROM ({_leaf('onin')} UNION {_leaf('theand')})) AS either, (SELECT count(*) FROM stats) AS every,
  (SELECT count(*) FROM ({_leaf('ererin')} EXCEPT ({_leaf('onin')} UNION {_leaf('theand')}))) AS common))"""),
    "sentence_candidates": sql("SELECT qid, rank::BIGINT AS rank, n::BIGINT AS pos, chunk_id, text, relevance FROM cand"),
    "mmr_answer": sql("SELECT qid, turn::BIGINT AS turn, rank::BIGINT AS rank, n::BIGINT AS pos, chunk_id, text, relevance FROM (SELECT * FROM m1 UNION ALL BY NAME SELECT * FROM m2 UNION ALL BY NAME SELECT * FROM m3)"),
    "answer_vector": sql("SELECT qid, term, round((1 + ln(f)) / sqrt(sum((1 + ln(f)) ** 2) OVER (PARTITION BY qid)), 6) AS weight FROM qt"),
    "support_scores": sql("SELECT cid, chunk_id, round(cosine * (1 - least(1, 0.6 * penalty)), 6) AS mul, round(greatest(0, cosine - 0.6 * penalty), 6) AS sub FROM (SELECT cid, chunk_id, round(cosine, 6) AS cosine, round(penalty, 6) AS penalty FROM cs)"),
    "verdict_counts": sql(f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM (SELECT round(greatest(0, least(1, cosine * (1 - least(1, 0.6 * penalty)))), 6) AS support, cid, rank, cosine, penalty FROM cs JOIN pairs USING (cid, chunk_id) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(greatest(0, least(1, cosine * (1 - least(1, 0.6 * penalty)))), 9) DESC, rank) = 1)) GROUP BY verdict"),
    "split_qids": sql("SELECT qid, CASE WHEN row_number() OVER (ORDER BY qid::BIGINT) <= CASE WHEN (SELECT count(*) FROM qs) > 100 THEN 100 ELSE greatest(1, (SELECT count(*) FROM qs) // 2) END THEN 'dev' ELSE 'test' END AS part FROM qs"),
    "verifier_items": sql("SELECT qid, doc_id, label FROM items"),
    "verifier_scores": sql("SELECT qid, doc_id, label, round(cosine, 6) AS cosine, round(penalty, 6) AS penalty, round(jaccard, 6) AS jaccard FROM iscores"),
    "score_histogram": sql("SELECT label, least(24, floor(round(cosine, 9) * 25))::BIGINT AS bin, count(*) AS n FROM iscores GROUP BY ALL"),
    "tune_threshold": sql("SELECT threshold, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM (SELECT threshold, count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn FROM (SELECT threshold, gold, round(cosine, 9) >= threshold AS said FROM iscores, (SELECT unnest(range(5, 71, 5)) / 100 AS threshold)) GROUP BY threshold) ORDER BY round(f1, 9) DESC, threshold LIMIT 1"),
    "tune_penalty": sql("SELECT form, weight, threshold, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM (SELECT form, weight, threshold, count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn FROM (SELECT form, weight, threshold, gold, round(least(1, greatest(0, CASE WHEN form = 'mul' THEN cosine * (1 - least(1, weight * penalty)) ELSE cosine - weight * penalty END)), 9) >= threshold AS said FROM iscores, (SELECT unnest(['sub', 'mul']) AS form), (SELECT unnest([0, 0.3, 0.6, 0.9, 1.2, 1.5]::DOUBLE[]) AS weight), (SELECT unnest(range(5, 71, 5)) / 100 AS threshold)) GROUP BY ALL) ORDER BY round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) DESC, form DESC, weight, threshold LIMIT 1"),
    "binary_metrics": sql("SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / nullif(n, 0), 6) AS accuracy, n FROM (SELECT count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn, count(*) FILTER (NOT said AND NOT gold) AS tn, count(*) AS n FROM (SELECT gold, round(jaccard, 9) >= 0.05 AS said FROM iscores))"),
    "hit_at_k": sql("SELECT round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hit10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count(*) AS n FROM items i LEFT JOIN (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM toprox JOIN chunks USING (chunk_id) GROUP BY qid, doc_id) p ON i.qid = p.qid AND i.doc_id = p.doc_id WHERE i.doc_id IS NOT NULL"),
    "tune_proximity": sql("SELECT point::BIGINT AS point, weight, win::BIGINT AS window, eta AS prior, round(ndcg, 6) AS ndcg FROM grid JOIN (SELECT point, avg(coalesce(ndcg, 0)) AS ndcg FROM (SELECT p.point, t.qid, ndcg FROM total t CROSS JOIN (SELECT point FROM grid) p LEFT JOIN gper g ON g.point = p.point AND g.qid = t.qid) GROUP BY point) USING (point)"),
    "chunk_finance": sql(f"SELECT chunk_id, text, a::BIGINT AS sentence_start, b::BIGINT AS sentence_end, CASE WHEN fin THEN len(list_filter(string_split({_norm('text', _FIN)}, ' '), lambda x: x <> '')) ELSE {_count('text')} END::BIGINT AS tokens FROM finchunks"),
    "excerpt": "SELECT item_id::VARCHAR AS qid, (CASE WHEN greatest(0, hit - 70) > 0 THEN '…' ELSE '' END) || trim(text[greatest(0, hit - 70) + 1 : least(length(text), hit + 70)]) || (CASE WHEN least(length(text), hit + 70) < length(text) THEN '…' ELSE '' END) AS excerpt FROM (SELECT item_id, text, coalesce(least(nullif(instr(lower(text), 'the'), 0), nullif(instr(lower(text), 'and'), 0)) - 1, 0) AS hit FROM benchmark)",
    "parse_citations": f"""SELECT qid, pos, text, array_to_string(CASE WHEN len(c) = 0 THEN [1] ELSE c END, ',') AS citations FROM (SELECT qid, pos, trim(regexp_replace(s, '\\s*\\[\\d+\\]', '', 'g'), {_BLANK}) AS text, list_filter(list_transform(regexp_extract_all(s, '\\[(\\d+)\\]', 1), lambda x: substring(x, 1, 18)::BIGINT), lambda x: x BETWEEN 1 AND 5) AS c
FROM (SELECT qid, unnest(range(0, len(ss))) AS pos, unnest(ss) AS s FROM (SELECT qid, {_sents("replace(text, chr(10), ' ')")} AS ss FROM (SELECT conv_id || '/' || turn AS qid, regexp_replace(text, '([a-z])\\.', '\\1 [2][9].', 'g') AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)))) WHERE text <> ''""",
}

