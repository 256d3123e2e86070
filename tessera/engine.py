"""The engine as an object: one saved index, and JSON-like answers to single requests."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators import boolean as B
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.operators import verify as V
from tessera.plans.config import AnalyzerConfig, IndexConfig, SearchConfig, VerifyConfig
from tessera.plans.storage import written
from tessera.sources.readers import META, is_finance

#: Thresholds of answers; single claims use those of VerifyConfig.
ASK = VerifyConfig(high=0.35, low=0.18)
DISCLAIMER = "From the retrieved filings only; no financial advice. Check the sources and ask a qualified professional."


def build(docs: DataFrame, config: IndexConfig | None = None) -> I.Index:
    """An index of docs. Without a config, filings (documents with a ticker, filing type or period) get finance rules."""
    if config is None:
        config = IndexConfig(strategy="finance", analyzer=AnalyzerConfig(finance_mode=True)) if is_finance(docs) else IndexConfig()
    elif config.strategy == "finance":
        config = replace(config, analyzer=replace(config.analyzer, finance_mode=True))
    return I.build(docs, config)


def _rounded(row: Row) -> dict:
    return {k: round(v, 4) if isinstance(v, float) else [x.asDict() if isinstance(x, Row) else x for x in v] if isinstance(v, list) else v for k, v in row.asDict().items()}


class Engine:
    def __init__(self, index: I.Index):
        self.index = index
        self.finance = index.config.analyzer.finance_mode

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(I.Index.load(spark, path))

    def _one(self, text: str) -> DataFrame:
        return self.index.spark.createDataFrame([("q", text)], "qid string, text string")

    def _hits(self, ranked: DataFrame) -> list[dict]:
        """At most k rows, with their chunks."""
        chunks = self.index.chunks
        meta = [m for m in (*META, "lang", "source") if m in chunks.columns]
        rows = ranked.join(chunks.select("chunk_id", F.col("doc_id").alias("parent_doc"), "title", "text", *meta), "chunk_id").orderBy("rank").collect()
        return [{k: v for k, v in _rounded(r).items() if k != "qid" and k not in meta} | {"meta": {m: r[m] for m in meta if r[m] is not None}} for r in rows]

    def _trace(self, query: DataFrame, config: SearchConfig) -> dict:
        terms = S.query_terms(self.index, query)
        return {
            "query_terms": [r.term for r in terms.orderBy("pos").collect()],
            "eliminated": [[r.term, r.reason] for r in S.eliminated(self.index, terms, config.eliminate).orderBy("term").collect()],
            "term_stats": {r.term: _rounded(r) for r in S.explain(self.index, query, config).drop("qid").collect()},
            "candidates": S.components(self.index, query, replace(config, proximity_weight=0.0, static_weight=0.0)).count(),
        }

    def stats(self) -> dict:
        r = I.build_stats(self.index).first()
        c = self.index.config
        return {"n_docs": r.docs, "n_chunks": self.index.n, "n_terms": r.terms, "avg_chunk_tokens": r.avg_tokens, "strategy": c.strategy, "stemming": c.analyzer.stemming, "finance_mode": self.finance}

    def search(self, query: str, config: SearchConfig = SearchConfig()) -> dict:
        one = self._one(query)
        return {"query": query, "hits": self._hits(S.search(self.index, one, config)), "trace": self._trace(one, config)}

    def term(self, term: str, limit: int = 8) -> dict:
        """An index term as it is stored, not analysed."""
        found = I.describe_term(self.index, self.index.spark.createDataFrame([(term,)], "term string"), limit).first()
        return {k: v if v is not None else [] for k, v in _rounded(found).items()}

    def boolean(self, query: str, limit: int = 20) -> dict:
        found = written(B.boolean(self.index, query), "boolean")
        rows = found.orderBy("chunk_id").limit(limit).join(self.index.chunks.select("chunk_id", F.col("doc_id").alias("parent_doc"), "title", "text"), "chunk_id").orderBy("chunk_id").collect()
        return {"query": query, "n_results": found.count(), "hits": [r.asDict() for r in rows], "trace": [r.asDict() for r in B.trace(self.index, query).orderBy("step").collect()]}

    def verify(self, claim: str, k: int = 5, config: VerifyConfig = VerifyConfig()) -> dict:
        """One claim against its k best chunks by the default search."""
        one = self._one(claim)
        ranked = written(S.search(self.index, one, SearchConfig(k=k)), "ranked")
        scored = V.claim_scores(self.index, one.withColumnRenamed("qid", "cid"), ranked.select(F.col("qid").alias("cid"), "chunk_id")).drop("cid")
        support = V.support(F.col("cosine"), F.col("penalty"), config.novelty_weight)
        rows = self._hits(ranked.select("rank", "chunk_id").join(scored, "chunk_id").withColumn("support", support))
        best = max([r["support"] for r in rows], default=0.0)
        for r in rows:
            r["novelty_penalty"], r["novel_terms"], r["text"] = r.pop("penalty"), r.pop("novel")[:10], r["text"][:400]
        said = "SUPPORTED" if best >= config.high else "WEAK" if best >= config.low else "UNSUPPORTED"
        terms = [r.term for r in S.query_terms(self.index, one).orderBy("pos").collect()]
        return {"claim": claim, "terms": terms, "best_support": best, "verdict": said, "high": config.high, "low": config.low, "rows": rows}

    def ask(self, query: str, config: SearchConfig = SearchConfig(k=5), sentences: int = 3, verify: VerifyConfig = ASK, generate=None, explain: bool = False) -> dict:
        """An answer in sentences of the best chunks, or by generate (prompt -> text with [n] marks), each checked."""
        began, one = time.time(), self._one(query)
        ranked = written(S.search(self.index, one, config), "ranked")
        if generate:
            said = V.parse_cited(V.generated(V.build_prompt(self.index, ranked, one), generate), ranked)
        else:
            said = V.answer(self.index, ranked, one, sentences).select("qid", F.col("turn").alias("pos"), "text", F.array(F.col("rank").cast("bigint")).alias("citations"), "chunk_id", "relevance")
        said = written(said, "answer")
        checked = [_rounded(r) for r in V.verify_answer(self.index, said.select("qid", "pos", "text", "citations"), ranked, verify).orderBy("pos").drop("qid").collect()]
        counts: dict[str, int] = {}
        for r in checked:
            counts[r["verdict"]] = counts.get(r["verdict"], 0) + 1
        out = {
            "query": query, "retrieved": self._hits(ranked), "answer": [_rounded(r) for r in said.orderBy("pos").drop("qid").collect()], "verification": checked, "verdicts": counts,
            "elapsed_ms": round((time.time() - began) * 1000, 1), "generator": "llm" if generate else "extractive", "finance_mode": self.finance, "disclaimer": DISCLAIMER if self.finance else None,
        }
        return out | {"trace": self._trace(one, config)} if explain else out
