"""Extractive answers and the checking of claims against chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import NUMERIC_CLAIM, analyze, citations, sentences, without_citations
from tessera.operators.index import Index, effective_tf
from tessera.operators.search import BROADCAST, query_terms, query_vector, small
from tessera.plans.config import AnalyzerConfig, VerifyConfig
from tessera.plans.storage import written


def sentence_candidates(index: Index, ranked: DataFrame, queries: DataFrame, least: float = 0.02) -> DataFrame:
    """qid, rank, pos, chunk_id, text, relevance: sentences of the retrieved chunks that are close to the query."""
    split = ranked.select("qid", "rank", "chunk_id").join(index.chunks.select("chunk_id", "text"), "chunk_id")
    sents = split.select("qid", "rank", "chunk_id", F.posexplode(sentences(F.col("text"))).alias("n", "text"))
    keys = ["qid", "rank", "n"]
    terms = written(analyze(sents, keys, "text", index.config.analyzer), "sentence-terms")
    long = terms.groupBy(*keys).agg(F.count("*").alias("terms")).filter("terms >= 4")
    vec = query_vector(index, terms, keys)
    qvec = query_vector(index, query_terms(index, queries), ["qid"]).select("qid", "term", F.col("qw").alias("q"))
    rel = vec.join(qvec, ["qid", "term"]).groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.col("qw") * F.col("q"))).alias("rel"))
    return sents.join(long, keys, "left_semi").join(rel, keys).filter(F.col("rel") >= least).select("qid", "rank", F.col("n").alias("pos"), "chunk_id", "text", F.round("rel", 4).alias("relevance"))


def answer(index: Index, ranked: DataFrame, queries: DataFrame, m: int = 3, balance: float = 0.7) -> DataFrame:
    """qid, turn, rank, pos, chunk_id, text, relevance: m sentences by maximal marginal relevance.

    Each turn takes the candidate of the greatest balance * relevance - (1 - balance) * (its greatest cosine to those
    taken); ties go to the lower rank, then the earlier sentence. A query has a bounded number of candidates.
    """
    found = written(sentence_candidates(index, ranked, queries).withColumnRenamed("pos", "n"), "candidates")
    keys = ["qid", "rank", "n"]
    vec = written(query_vector(index, analyze(found, keys, "text", index.config.analyzer), keys).select(*keys, "term", "qw"), "sentence-vectors")
    left, taken = found.withColumn("near", F.lit(0.0)), None
    for turn in range(1, m + 1):
        order = Window.partitionBy("qid").orderBy(F.desc(F.round(balance * F.col("relevance") - (1 - balance) * F.col("near"), 9)), "rank", "n")
        ordered = written(left.withColumn("o", F.row_number().over(order)), "turn")
        pick = ordered.filter("o = 1").drop("o", "near").withColumn("turn", F.lit(turn))
        taken = pick if taken is None else taken.unionByName(pick)
        chosen = pick.select(*keys).join(vec, keys).select("qid", "term", F.col("qw").alias("c"))
        cos = vec.join(chosen, ["qid", "term"]).groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.col("qw") * F.col("c"))).alias("cos"))
        left = ordered.filter("o > 1").drop("o").join(cos, keys, "left").withColumn("near", F.greatest("near", F.coalesce("cos", F.lit(0.0)))).drop("cos")
    return taken.select("qid", "turn", "rank", F.col("n").alias("pos"), "chunk_id", "text", "relevance")


def parse_cited(answers: DataFrame, sources: int | DataFrame) -> DataFrame:
    """qid, pos, text, citations of the sentences of cited texts (qid, text); sources: how many there are, or what was retrieved
    (qid, rank), where each query has as many as it has rows."""
    if isinstance(sources, DataFrame):
        counted = answers.join(sources.groupBy("qid").agg(F.count("*").alias("sources")), "qid", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    else:
        counted = answers.withColumn("sources", F.lit(sources))
    sents = counted.select("qid", "sources", F.posexplode(sentences(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("pos", "s"))
    return sents.select("qid", "pos", without_citations(F.col("s")).alias("text"), citations(F.col("s"), F.col("sources")).alias("citations")).filter("text <> ''")


#: What a generator is told, and what more where the sources are filings.
RULE = "Answer from the numbered sources alone, citing them as [n] after each sentence; say so if they hold no answer."
FILINGS_RULE = " The sources are excerpts of filings and may be incomplete: give figures exactly as cited, conclude none beyond them, and add that this is no financial advice."


def build_prompt(index: Index, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, prompt: numbered sources, filings with ticker, type and period, and the query, for a generator outside."""
    meta = [F.coalesce(F.col(m), F.lit("")) if m in index.chunks.columns else F.lit("") for m in ("ticker", "filing_type", "period")]
    filing = F.when(meta[0] != "", F.concat(F.lit(" ("), F.concat_ws(" ", *meta), F.lit(")"))).otherwise(F.lit(""))
    source = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), filing, F.lit("\n"), F.col("text"))
    parts = ranked.select("qid", "rank", "chunk_id").join(index.chunks, "chunk_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))).alias("p"))
    rule = RULE + FILINGS_RULE * index.config.analyzer.finance_mode
    body = F.array_join(F.transform("p", lambda x: x["s"]), "\n\n")
    return parts.join(queries.select("qid", "text"), "qid").select("qid", F.concat(F.lit(rule + "\n\nSources:\n"), body, F.lit("\n\nQuery: "), F.col("text"), F.lit("\n\nAnswer:")).alias("prompt"))


def generated(prompts: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """qid, text: what a generator outside (a function of the prompt, shipped to the executors) says; parse_cited takes it."""

    def said(batches):
        for b in batches:
            yield b.assign(text=b["prompt"].map(generate))[["qid", "text"]]

    return prompts.select("qid", "prompt").mapInPandas(said, "qid string, text string")


def unit_vector(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, weight: logarithmic term counts at unit length, without idf."""
    counted = terms.groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("w"))
    return counted.select(*keys, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).alias("weight"))


def verdict_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("verdict").agg(F.count("*").alias("n"))


def support(cos: Column, penalty: Column, weight: float, form: str = "mul") -> Column:
    raw = cos * (1 - F.least(F.lit(1.0), weight * penalty)) if form == "mul" else cos - weight * penalty
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def claim_scores(index: Index, claims: DataFrame, pairs: DataFrame, analyzer: AnalyzerConfig | None = None) -> DataFrame:
    """cid, chunk_id, cosine, penalty, novel of pairs (cid, chunk_id); claims: cid, text.

    The penalty is the idf share of the claim's terms that the chunk lacks; terms that the corpus lacks, or that all chunks
    hold, do not count. In finance mode numbers count half as much again. Claims are analysed as the index was, unless an
    analyzer is given.
    """
    terms = analyze(claims, ["cid"], "text", analyzer or index.config.analyzer)
    vec = query_vector(index, terms, ["cid"]).filter("idf > 0")
    wanted = small(pairs.join(vec, "cid"), "claim-terms")
    here = wanted.select("term", "chunk_id").distinct()
    held = index.postings.select("term", "chunk_id", "tf", "tf_title", "norm").join(F.broadcast(here) if here.count() <= BROADCAST else here, ["term", "chunk_id"], "left_semi").withColumn("there", F.lit(True))
    weight = F.when(F.col("term").rlike(NUMERIC_CLAIM), 1.5).otherwise(1.0) if index.config.analyzer.finance_mode else F.lit(1.0)
    each = wanted.join(held, ["term", "chunk_id"], "left").withColumn("i", F.col("idf") * weight)
    novel = F.col("there").isNull()
    scored = each.groupBy("cid", "chunk_id").agg(
        F.least(F.lit(1.0), F.coalesce(F.sum(F.col("qw") * (1 + F.log(effective_tf(index.config.zone_weight))) / F.col("norm")), F.lit(0.0))).alias("cosine"),
        (F.coalesce(F.sum(F.when(novel, F.col("i"))), F.lit(0.0)) / F.sum("i")).alias("penalty"),
        F.array_sort(F.collect_list(F.when(novel, F.col("term")))).alias("novel"),
    )
    none = F.array().cast("array<string>")
    return pairs.join(scored, ["cid", "chunk_id"], "left").select("cid", "chunk_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"), F.coalesce("novel", none).alias("novel"))


def verdict(support_: Column, config: VerifyConfig) -> Column:
    return F.when(support_ >= config.high, "SUPPORTED").when(support_ >= config.low, "WEAK").otherwise("UNSUPPORTED")


def verify_claims(index: Index, claims: DataFrame, ranked: DataFrame, config: VerifyConfig = VerifyConfig()) -> DataFrame:
    """cid, chunk_id, support, verdict: each claim against the best of its retrieved chunks (ranked by qid = cid)."""
    pairs = ranked.select(F.col("qid").alias("cid"), "chunk_id", "rank")
    scored = claim_scores(index, claims, pairs.drop("rank")).withColumn("support", support(F.col("cosine"), F.col("penalty"), config.novelty_weight))
    order = Window.partitionBy("cid").orderBy(F.desc(F.round("support", 9)), "rank")
    best = scored.join(pairs, ["cid", "chunk_id"]).withColumn("o", F.row_number().over(order)).filter("o = 1")
    return best.select("cid", "chunk_id", "support", verdict(F.round("support", 9), config).alias("verdict"))


def verify_answer(index: Index, answers: DataFrame, ranked: DataFrame, config: VerifyConfig = VerifyConfig()) -> DataFrame:
    """Each answer sentence (qid, pos, text, citations) against the source it cites first, and against all sources. A sentence whose
    source was not retrieved has no cited chunk and no support."""
    claims = answers.withColumn("cid", F.concat_ws("/", "qid", F.col("pos").cast("string")))
    pairs = claims.select("qid", "cid", "citations").join(ranked.select("qid", "rank", "chunk_id"), "qid")
    scored = claim_scores(index, claims.select("cid", "text"), pairs.select("cid", "chunk_id")).withColumn("support", support(F.col("cosine"), F.col("penalty"), config.novelty_weight))
    all_ = pairs.join(scored, ["cid", "chunk_id"])
    order = Window.partitionBy("cid").orderBy(F.desc(F.round("support", 9)), "rank")
    best = all_.withColumn("o", F.row_number().over(order)).filter("o = 1").select("cid", F.col("rank").alias("best_rank"), F.col("support").alias("best_support"))
    cited = all_.filter(F.col("rank") == F.element_at("citations", 1))
    mismatch = ~F.array_contains("citations", F.col("best_rank").cast("bigint")) & (F.col("best_support") > F.col("support") + 0.10)
    said = verdict(F.round("support", 9), config)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    joined = claims.join(cited.select("cid", F.col("chunk_id").alias("cited_chunk"), "cosine", "novel", "penalty", "support"), "cid", "left").join(best, "cid", "left")
    joined = joined.select("qid", "pos", "text", "citations", "cited_chunk", zero("cosine"), F.coalesce("novel", F.array().cast("array<string>")).alias("novel"), zero("penalty"), zero("support"), "best_rank", zero("best_support"))
    joined = joined.withColumn("cite_mismatch", F.coalesce(mismatch, F.lit(False)))
    return joined.select("qid", "pos", F.col("text").alias("claim"), "citations", "cited_chunk", F.round("cosine", 4).alias("cosine"), F.col("novel").alias("novel_terms"), F.round("penalty", 4).alias("novelty_penalty"), F.round("support", 4).alias("support"),
                         F.when(F.col("cite_mismatch") & (said == "SUPPORTED"), "SUPPORTED (cite mismatch)").otherwise(said).alias("verdict"), "best_rank", F.round("best_support", 4).alias("best_support"), "cite_mismatch")
