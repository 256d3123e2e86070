"""DuckDB SQL for queries that need several indexes, a recursion, or the answers: more steps, and the oracles made of them."""

from __future__ import annotations

from tessera.functions.text import FINANCE_FILING, FINANCE_NUMBER, FINANCE_PERIOD, FINANCE_TICKER, NUMERIC_CLAIM
from tessera.operators.verify import FILINGS_RULE, RULE
from tessera.plans.oracles import _FIN, _NEAR, _STOP, _STOP_FINANCE, ORACLES, STEPS, _count, _sents, _toks, sql

_WHOLE = "SELECT doc_id || '#0' AS chunk_id, doc_id, title, text FROM docs"
_FIVE = (
    "SELECT doc_id || '#' || k AS chunk_id, doc_id, title, array_to_string(s[3 * k + 1 : least(len(s), 3 * k + 5)], ' ') AS text FROM "
    "(SELECT *, unnest(range(0, greatest(0, ceil((len(s) - 5) / 3.0)::INT) + 1)) AS k FROM split WHERE len(s) > 0) "
    "UNION ALL SELECT doc_id || '#0', doc_id, title, text FROM split WHERE len(s) = 0"
)
# t[i + 1] is the number of tokens of the first i sentences; a chunk ends at the first sentence that brings it to 120, and the next begins where the closing sentences are worth 30
_FIXED = f"""SELECT doc_id || '#' || k AS chunk_id, doc_id, title, array_to_string(s[b : coalesce(e, len(s))], ' ') AS text, b - 1 AS a, coalesce(e, len(s)) AS z, t[coalesce(e, len(s)) + 1] - t[b] AS tokens FROM (
  WITH RECURSIVE counted AS (SELECT doc_id, title, s, list_transform(s, lambda x: {_count('x')}) AS c FROM split WHERE len(s) > 0),
  summed AS (SELECT doc_id, title, s, list_transform(range(0, len(c) + 1), lambda i: coalesce(list_sum(c[1 : i]), 0)::BIGINT) AS t FROM counted),
  steps AS (
    SELECT *, 0 AS k, 1::BIGINT AS b, list_first(list_filter(range(1, len(s) + 1), lambda x: t[x + 1] - t[1] >= 120)) AS e FROM summed
    UNION ALL
    SELECT doc_id, title, s, t, k + 1, nb, list_first(list_filter(range(e + 1, len(s) + 1), lambda x: t[x + 1] - t[nb] >= 120)) FROM (
      SELECT *, CASE WHEN back = b THEN e + 1 ELSE back END AS nb FROM (SELECT *, coalesce(list_last(list_filter(range(b, e + 1), lambda x: t[e + 1] - t[x] >= 30)), b) AS back FROM steps WHERE e IS NOT NULL)
    ) WHERE nb <= len(s)
  ) SELECT * FROM steps
) UNION ALL SELECT doc_id || '#0', doc_id, title, text, 0, 0, {_count('text')} FROM split WHERE len(s) = 0"""

_KEPT = " OR ".join(f"regexp_matches(token, '{p}')" for p in (FINANCE_NUMBER, FINANCE_TICKER, FINANCE_PERIOD, FINANCE_FILING, "[0-9]", r"^\$"))


def _index(p: str, chunks: str, stem: str = "stem", zone: int = 2, stop: str = _STOP, kept: str | None = None, distance: int = 30) -> dict[str, str]:
    """The steps of an index over a table of chunks, their names beginning with p. Its words must be among those of the plain one,
    unless it has stems of its own."""
    toks = _toks("t", stop, kept) if kept else _toks("t", stop)
    asked = _toks("text", stop, kept) if kept else _toks("text", stop)
    eff = "(tf + tf_title)" if zone == 2 else "tf"
    stems = f"{p}stems" if kept else "stems"
    same = {"held": f"{p}held"}
    steps = {
        f"{p}occ": f"SELECT chunk_id, unnest(range(0, len(w))) + gap AS p, unnest(w) AS token FROM (SELECT chunk_id, gap, {toks} AS w FROM (SELECT chunk_id, 0 AS gap, title AS t FROM {chunks} UNION ALL SELECT chunk_id, 1000, text FROM {chunks}))",
        f"{p}qtok": f"SELECT qid, unnest({asked}) AS token FROM qs",
    }
    if kept:
        from tessera.functions.stemmer import DUCKDB, Rules

        steps[f"{p}vocab"] = f"SELECT DISTINCT token FROM (SELECT token FROM {p}occ UNION ALL SELECT token FROM {p}qtok)"
        steps[f"{p}plain"] = Rules(DUCKDB).query(f"{p}vocab")
        steps[stems] = f"SELECT token, CASE WHEN {_KEPT} THEN token ELSE stem END AS stem FROM {p}plain"
    return steps | {
        f"{p}postings": f"SELECT {stem} AS term, chunk_id, count(*) AS tf, count(*) FILTER (p < 1000) AS tf_title, list(p ORDER BY p) AS ps FROM {p}occ JOIN {stems} USING (token) GROUP BY ALL",
        f"{p}n": f"SELECT count(DISTINCT chunk_id) AS n FROM {p}postings",
        f"{p}terms": f"SELECT term, count(*) AS df, ln(any_value(n) / count(*)) AS idf, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS bm25_idf FROM {p}postings, {p}n GROUP BY term",
        f"{p}stats": f"SELECT chunk_id, sum(tf)::BIGINT AS length, sqrt(sum((1 + ln({eff})) ** 2)) AS norm FROM {p}postings GROUP BY chunk_id",
        f"{p}qt": f"SELECT qid, {stem} AS term, count(*) AS f FROM {p}qtok JOIN {stems} USING (token) GROUP BY ALL",
        f"{p}qraw": f"SELECT qid, term, df, idf, bm25_idf, CASE WHEN idf > 0 THEN (1 + ln(f)) * idf ELSE 0 END AS w FROM {p}qt JOIN {p}terms USING (term)",
        f"{p}qvec": f"SELECT *, CASE WHEN sum(w * w) OVER (PARTITION BY qid) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY qid)) ELSE 0 END AS qw FROM {p}qraw",
        f"{p}tfidf": f"SELECT qid, chunk_id, sum(qw * (1 + ln({eff})) / norm) AS base FROM {p}qvec JOIN {p}postings USING (term) JOIN {p}stats USING (chunk_id) GROUP BY ALL",
        f"{p}held": f"SELECT qid, term, chunk_id, ps FROM {p}qvec JOIN {p}postings USING (term)",
        f"{p}near": _NEAR.format(w=distance).replace("FROM held x JOIN held y", f"FROM {same['held']} x JOIN {same['held']} y"),
        f"{p}prox": f"SELECT t.qid, t.chunk_id, base * (1 + 0.5 * coalesce(close / (u * (u - 1) / 2), 0)) AS score FROM {p}tfidf t JOIN (SELECT qid, count(*) AS u FROM {p}qvec GROUP BY qid) USING (qid) LEFT JOIN {p}near x USING (qid, chunk_id)",
    }


def _bm25(p: str, k1: float, b: float) -> str:
    return f"SELECT qid, chunk_id, sum(qw * bm25_idf * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * length / al))) AS score FROM {p}qvec JOIN {p}postings USING (term) JOIN {p}stats USING (chunk_id), (SELECT avg(length) AS al FROM {p}stats) GROUP BY ALL"


def _mean(scored: str, chunks: str = "chunks") -> str:
    """The mean metrics of a ranking of a hundred chunks (qid, chunk_id, score)."""
    ranked = f"SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ({scored}) QUALIFY rank <= 100"
    parents = f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM ({ranked}) JOIN {chunks} USING (chunk_id) GROUP BY qid, doc_id"
    hits = f"(SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) AS h FROM ({parents}) JOIN rels USING (qid, doc_id))"
    per = STEPS["per"].replace("FROM hits", f"FROM {hits}")
    value = {"ndcg": "ndcg", "p5": "p5", "p10": "p10", "r100": "h100 / total", "mrr": "mrr", "ap": "cum / total"}
    return f"SELECT {', '.join(f'round(avg(coalesce({v}, 0)), 6) AS {n}' for n, v in value.items())} FROM total LEFT JOIN ({per}) USING (qid)"


STEPS |= {"wchunks": _WHOLE, "vchunks": _FIVE, "fchunks": _FIXED, "nchunks": "SELECT f.chunk_id, d.doc_id, d.title, f.text, coalesce(upper(d.source), '') AS ticker, coalesce(d.lang, '') AS filing_type, 'FY' || (d.doc_id::BIGINT % 5 + 2018) AS period FROM finchunks f JOIN docs d ON d.doc_id = split_part(f.chunk_id, '#', 1)"}
STEPS |= _index("r", "chunks", "token", 1) | _index("z", "chunks", "stem", 1) | _index("w", "wchunks") | _index("f", "fchunks") | _index("v", "vchunks") | _index("n", "nchunks", stop=_STOP_FINANCE, kept=_FIN)
STEPS |= {
    "said": "SELECT qid, turn, rank, n, chunk_id, text FROM (SELECT * FROM m1 UNION ALL BY NAME SELECT * FROM m2 UNION ALL BY NAME SELECT * FROM m3)",
    "judged": "SELECT s.qid, s.turn, t.rank AS r, t.chunk_id, least(1, coalesce(sum(v.qw * (1 + ln(o.tf + o.tf_title)) / c.norm), 0)) AS cosine, coalesce(sum(k.idf) FILTER (o.tf IS NULL), 0) / sum(k.idf) AS penalty, coalesce(string_agg(v.term, ' ' ORDER BY v.term) FILTER (o.tf IS NULL), '') AS novel FROM said s JOIN toprox t ON t.qid = s.qid AND t.rank <= 5 JOIN sv v ON v.qid = s.qid AND v.rank = s.rank AND v.n = s.n JOIN terms k ON k.term = v.term AND k.idf > 0 LEFT JOIN postings o ON o.term = v.term AND o.chunk_id = t.chunk_id LEFT JOIN stats c ON c.chunk_id = t.chunk_id GROUP BY ALL",
    "backed": "SELECT *, greatest(0, least(1, cosine * (1 - least(1, 0.6 * penalty)))) AS support FROM judged",
    "bestof": "SELECT qid, turn, r AS best_rank, support AS best_support FROM backed QUALIFY row_number() OVER (PARTITION BY qid, turn ORDER BY round(support, 9) DESC, r) = 1",
    "parts": ORACLES["split_qids"][ORACLES["split_qids"].index("SELECT qid, CASE") :],
    "devs": "SELECT * FROM iscores SEMI JOIN (SELECT qid FROM parts WHERE part = 'dev') d USING (qid)",
    "tests": "SELECT * FROM iscores SEMI JOIN (SELECT qid FROM parts WHERE part = 'test') d USING (qid)",
}
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"
_SUPPORT = "least(1, greatest(0, CASE WHEN form = 'mul' THEN cosine * (1 - least(1, weight * penalty)) ELSE cosine - weight * penalty END))"
_TRIED = "(SELECT unnest(['sub', 'mul']) AS form), (SELECT unnest([0, 0.3, 0.6, 0.9, 1.2, 1.5]::DOUBLE[]) AS weight), (SELECT unnest(range(5, 71, 5)) / 100 AS threshold)"
_SUMS = "count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn"


def _tuned(score: str) -> str:
    return f"SELECT '{score}' AS method, threshold FROM (SELECT threshold, {_SUMS} FROM (SELECT threshold, gold, round({score}, 9) >= threshold AS said FROM devs, (SELECT unnest(range(5, 71, 5)) / 100 AS threshold)) GROUP BY threshold) ORDER BY round({_F1}, 9) DESC, threshold LIMIT 1"


def _measured(items: str) -> str:
    return f"SELECT method, threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy, n FROM (SELECT method, threshold, {_SUMS}, count(*) FILTER (NOT said AND NOT gold) AS tn, count(*) AS n FROM ({items}) GROUP BY ALL)"


_PENALTY = f"SELECT form, weight, threshold FROM (SELECT form, weight, threshold, {_SUMS} FROM (SELECT form, weight, threshold, gold, round({_SUPPORT}, 9) >= threshold AS said FROM devs, {_TRIED}) GROUP BY ALL) ORDER BY round({_F1}, 9) DESC, form DESC, weight, threshold LIMIT 1"
_CHAMPIONS = "SELECT b.qid, b.chunk_id, base * (1 + 0.5 * CASE WHEN matched >= 2 THEN coalesce(close / (u * (u - 1) / 2), 0) ELSE 0 END) AS score FROM (SELECT qid, chunk_id, sum(qw * (1 + ln(tf + tf_title)) / norm) AS base, count(*) AS matched FROM qvec JOIN postings USING (term) SEMI JOIN champs USING (term, chunk_id) JOIN stats USING (chunk_id) GROUP BY ALL) b JOIN used USING (qid) LEFT JOIN near x USING (qid, chunk_id)"
_LADDER = {
    "plain": "SELECT qid, chunk_id, base AS score FROM rtfidf", "stemmed": "SELECT qid, chunk_id, base AS score FROM ztfidf", "titles": "SELECT qid, chunk_id, base AS score FROM tfidf",
    "proximity": "SELECT qid, chunk_id, score FROM prox", "prior": "SELECT qid, chunk_id, score FROM prox", "champions": _CHAMPIONS, "bm25 1.5 0.75": _bm25("z", 1.5, 0.75), "bm25 0.9 0.4": _bm25("z", 0.9, 0.4),
}
_CHUNKINGS = {"whole": ("w", "wchunks"), "fixed": ("f", "fchunks"), "sentence 5/3": ("v", "vchunks"), "sentence 3/2": ("", "chunks")}
_VERDICT = "CASE WHEN round(support, 9) >= 0.2 THEN 'SUPPORTED' WHEN round(support, 9) >= 0.12 THEN 'WEAK' ELSE 'UNSUPPORTED' END"


def _prompt(rule: str, filing: str, top: str, chunks: str) -> str:
    return f"""SELECT qid, '{rule}' || chr(10) || chr(10) || 'Sources:' || chr(10) || body || chr(10) || chr(10) || 'Query: ' || text || chr(10) || chr(10) || 'Answer:' AS prompt
FROM (SELECT qid, string_agg('[' || rank || '] ' || title || {filing} || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS body FROM ({top}) JOIN {chunks} c USING (chunk_id) GROUP BY qid) JOIN qs USING (qid)"""


_FILED = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(base, 9) DESC, chunk_id) AS rank, chunk_id, base AS score FROM ntfidf QUALIFY rank <= 10"
_MARKED = "regexp_replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(?i)\\b(onin|and|the)\\b', '<mark class=\"hit\">\\1</mark>', 'g')"
ORACLES_MORE = {
    "snippet": f"""SELECT qid, CASE WHEN length(text) <= 120 THEN {_MARKED.format(t='text')} ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || {_MARKED.format(t='text[b + 1 : b + 120]')} || '…' END AS snippet
FROM (SELECT item_id::VARCHAR AS qid, text, greatest(0, coalesce(nullif(instr(lower(text), 'onin'), 0), nullif(instr(lower(text), 'the'), 0), nullif(instr(lower(text), 'and'), 0), 1) - 1 - 20) AS b FROM benchmark)""",
    "chunk_fixed": sql("SELECT chunk_id, text, a::BIGINT AS sentence_start, z::BIGINT AS sentence_end, tokens::BIGINT AS tokens FROM fchunks"),
    "verify_answers": sql(f"""SELECT qid, turn::BIGINT AS pos, text AS claim, rank::VARCHAR AS citations, b.chunk_id AS cited_chunk, round(cosine, 4) AS cosine, novel AS novel_terms, round(penalty, 4) AS novelty_penalty, round(support, 4) AS support,
  CASE WHEN mismatch AND {_VERDICT} = 'SUPPORTED' THEN 'SUPPORTED (cite mismatch)' ELSE {_VERDICT} END AS verdict, best_rank::BIGINT AS best_rank, round(best_support, 4) AS best_support, mismatch AS cite_mismatch
FROM (SELECT s.qid, s.turn, s.text, s.rank, b.chunk_id, b.cosine, b.novel, b.penalty, b.support, best_rank, best_support, best_rank <> s.rank AND best_support > b.support + 0.10 AS mismatch FROM said s JOIN backed b ON b.qid = s.qid AND b.turn = s.turn AND b.r = s.rank JOIN bestof x ON x.qid = s.qid AND x.turn = s.turn) b"""),
    "build_prompt": sql(_prompt(RULE, "''", "SELECT qid, rank, chunk_id FROM toprox WHERE rank <= 3", "chunks")),
    "evidence_recall": sql(f"""SELECT count(*) AS n, round(coalesce(avg(top), 0), 6) AS baseline, round(coalesce(avg(told), 0), 6) AS answer FROM (
  SELECT g.qid, g.doc_id, max(CASE WHEN t.s IS NULL THEN 0 ELSE 1 END) AS told, max(CASE WHEN f.s IS NULL THEN 0 ELSE 1 END) AS top FROM (
    SELECT DISTINCT qid, doc_id, ss[i - a + 1] AS s FROM (SELECT DISTINCT qid, doc_id, unnest([0, qid::BIGINT % 3]) AS i FROM items WHERE label = 'SUPPORT') JOIN (SELECT doc_id, a, {_sents('text')} AS ss FROM chunks) c USING (doc_id) WHERE i >= a AND i - a + 1 <= len(ss)
  ) g LEFT JOIN (SELECT DISTINCT qid, trim(text) AS s FROM said) t ON t.qid = g.qid AND t.s = g.s
  LEFT JOIN (SELECT qid, doc_id, {_sents('text')}[1] AS s FROM toprox JOIN chunks USING (chunk_id) WHERE rank = 1) f ON f.qid = g.qid AND f.doc_id = g.doc_id AND f.s = g.s GROUP BY g.qid, g.doc_id)"""),
    "eval_verifier": sql(f"""{_measured(f"SELECT 'support ' || form || ' ' || weight AS method, threshold, gold, round({_SUPPORT}, 9) >= threshold AS said FROM tests, ({_PENALTY})")}
UNION ALL {_measured(f"SELECT method, threshold, gold, round(cosine, 9) >= threshold AS said FROM tests, ({_tuned('cosine')})")} UNION ALL {_measured(f"SELECT method, threshold, gold, round(jaccard, 9) >= threshold AS said FROM tests, ({_tuned('jaccard')})")}"""),
    "ablation": sql(" UNION ALL ".join(f"SELECT '{name}' AS configuration, * FROM ({_mean(scored)})" for name, scored in _LADDER.items())),
    "chunk_ablation": sql(" UNION ALL ".join(f"SELECT '{name}' AS strategy, (SELECT n FROM {p}n) AS chunks, * FROM ({_mean(f'SELECT qid, chunk_id, score FROM {p}prox', chunks)})" for name, (p, chunks) in _CHUNKINGS.items())),
    "finance_search": sql(f"SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ({_FILED})"),
    "finance_claims": sql(f"SELECT cid, chunk_id, round(cosine, 6) AS cosine, round(penalty, 6) AS penalty, novel FROM (SELECT p.qid AS cid, p.chunk_id, least(1, coalesce(sum(qw * (1 + ln(tf + tf_title)) / norm), 0)) AS cosine, coalesce(sum(w) FILTER (tf IS NULL), 0) / sum(w) AS penalty, coalesce(string_agg(c.term, ' ' ORDER BY c.term) FILTER (tf IS NULL), '') AS novel FROM ({_FILED}) p JOIN (SELECT qid, term, qw, idf * CASE WHEN regexp_matches(term, '{NUMERIC_CLAIM}') THEN 1.5 ELSE 1 END AS w FROM nqvec WHERE idf > 0) c USING (qid) LEFT JOIN npostings o ON o.term = c.term AND o.chunk_id = p.chunk_id LEFT JOIN nstats s ON s.chunk_id = p.chunk_id WHERE p.rank <= 5 GROUP BY ALL)"),
    "finance_prompt": sql(_prompt(RULE + FILINGS_RULE, "' (' || ticker || ' ' || filing_type || ' ' || period || ')'", f"SELECT * FROM ({_FILED}) WHERE rank <= 3", "nchunks")),
    "bool_filing": sql("SELECT chunk_id FROM nchunks SEMI JOIN nstats USING (chunk_id) WHERE lower(ticker) = 'src1' AND (lower(period) = 'fy2019' OR lower(filing_type) = 'de')"),
}
