"""Ranked search over batches of queries (qid, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import analyze
from tessera.operators import batch
from tessera.operators.chunking import doc_of
from tessera.operators.index import Index, champions_of, effective_tf
from tessera.plans.config import IndexConfig, SearchConfig
from tessera.plans.storage import written

#: Rows of query terms up to which a batch is broadcast (a few MB).
BROADCAST = 200_000


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    return analyze(queries.select("qid", "text"), ["qid"], "text", index.config.analyzer)


def eliminated(index: Index, terms: DataFrame, threshold: float = 1.0) -> DataFrame:
    """qid, term, reason of the terms a search leaves out."""
    known = terms.select("qid", "term").distinct().join(index.term_stats.select("term", "df"), "term", "left")
    reason = F.when(F.col("df").isNull(), "not in dictionary").when(F.col("df") / index.n > threshold, F.concat(F.lit("df="), F.col("df").cast("string"), F.lit(" exceeds threshold")))
    return known.withColumn("reason", reason).filter("reason IS NOT NULL").select("qid", "term", "reason")


def query_vector(index: Index, terms: DataFrame, keys: list[str], threshold: float = 1.0) -> DataFrame:
    """keys, term, df, idf, bm25_idf, qw: unit-length tf-idf weights; terms in every chunk weigh 0."""
    known = terms.groupBy(*keys, "term").agg(F.count("*").alias("f")).join(index.term_stats, "term").filter(F.col("df") / index.n <= threshold)
    w = F.when(F.col("idf") > 0, (1 + F.log("f")) * F.col("idf")).otherwise(F.lit(0.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return known.withColumn("w", w).withColumn("norm", norm).select(*keys, "term", "df", "idf", "bm25_idf", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.lit(0.0)).alias("qw"))


def small(df: DataFrame, name: str = "queries") -> DataFrame:
    """df written and counted, to be broadcast if it has at most BROADCAST rows: a batch of queries, not a corpus."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST else kept


def term_scores(index: Index, qvec: DataFrame, config: SearchConfig = SearchConfig(), *more: str) -> DataFrame:
    """qid, term, chunk_id, w (and more columns of the postings): what each query term adds to each chunk that holds it."""
    found = (index.champions if config.champions and index.config.champions else index.postings).select("term", "chunk_id", "tf", "tf_title", "length", "norm", *more)
    eff = effective_tf(index.config.zone_weight)
    if config.method == "bm25":
        length = 1 - config.b + config.b * F.col("length") / max(index.avg_length, 1e-9)
        weight = F.col("qw") * F.col("bm25_idf") * eff * (config.k1 + 1) / (eff + config.k1 * length)
    else:
        weight = F.col("qw") * (1 + F.log(eff)) / F.col("norm")
    return found.join(qvec, "term").select("qid", "term", "chunk_id", weight.alias("w"), *more)


def close_pairs(lists: Column, window: int) -> Column:
    """How many pairs of position lists come within window of each other: one sweep over all positions in order."""
    marked = F.flatten(F.transform(lists, lambda ps, i: F.transform(ps, lambda p: F.struct(p.alias("p"), i.alias("i")))))

    def near(at: Column) -> Column:
        # at most two occurrences share a position, so what is close is among the next 2 * window
        ahead = lambda x, k: F.filter(F.slice(at, k + 2, 2 * window), lambda y: (y["p"] - x["p"] <= window) & (y["i"] != x["i"]))
        pairs = F.transform(at, lambda x, k: F.transform(ahead(x, k), lambda y: F.struct(F.least(x["i"], y["i"]).alias("a"), F.greatest(x["i"], y["i"]).alias("b"))))
        return F.size(F.array_distinct(F.flatten(pairs)))

    return F.transform(F.array(F.array_sort(marked)), near)[0]


def reaching(base: DataFrame, k: int, weight: float, prior: float) -> DataFrame:
    """Of the chunks and their base scores, all that can be among a query's k best: proximity and prior are 0 to 1, so a score lies
    between base and base * (1 + weight) + prior, and k chunks have at least the k-th greatest base. Ties are kept. With a column
    used (a query's terms), matched are all of them that a chunk holds, and no more than their pairs can be close."""
    share = F.col("matched") * (F.col("matched") - 1) / F.greatest(F.col("used") * (F.col("used") - 1), F.lit(1)) if "used" in base.columns else F.lit(1.0)
    order = Window.partitionBy("qid").orderBy(F.desc("base"))
    least = base.select("qid", "base").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("qid").agg(F.max("r").alias("r"), F.min("base").alias("kth"))
    bound = F.broadcast(least.select("qid", F.when(F.col("r") == k, F.col("kth")).otherwise(F.lit(0.0)).alias("kth")))
    return base.join(bound, "qid").filter(F.col("base") * (1 + weight * share) + prior >= F.col("kth") - 1e-6).drop("kth")


def components(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig(), reach: int | None = None) -> DataFrame:
    """qid, chunk_id, base, proximity, g of every chunk that holds a query term (with reach: of those that can be among a query's
    reach best for the weights of config); what has no weight is zero. Base scores come first, from postings without positions;
    positions are looked up for the chunks that are left."""
    qvec = small(query_vector(index, query_terms(index, queries), ["qid"], config.eliminate).withColumn("used", F.count("*").over(Window.partitionBy("qid"))))
    near = config.proximity_weight > 0
    scored = term_scores(index, qvec, config).groupBy("qid", "chunk_id").agg(F.sum("w").alias("base"), F.count("*").alias("matched"))
    if near or config.static_weight > 0:
        scored = written(scored, "base")
        if reach and config.proximity_weight >= 0 and config.static_weight >= 0:
            few = scored if config.champions and index.config.champions else scored.join(F.broadcast(qvec.select("qid", "used").distinct()), "qid")  # not all terms are champions' terms
            scored = written(reaching(few, reach, config.proximity_weight, config.static_weight).select(scored.columns), "reaching")
    if near:
        # champions carry no positions, and in postings most belong to chunks that do not matter
        pairs = scored.filter("matched >= 2").select("qid", "chunk_id")
        pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST else pairs
        held = index.postings.select("term", "chunk_id", "positions").join(qvec.select("qid", "term"), "term").join(pairs, ["qid", "chunk_id"], "left_semi")
        scored = scored.join(held.groupBy("qid", "chunk_id").agg(F.collect_list("positions").alias("lists")), ["qid", "chunk_id"], "left")
    if near:
        used = qvec.select("qid", "used").distinct()
        share = F.when(F.size("lists") >= 2, close_pairs(F.col("lists"), config.proximity_window) / (F.col("used") * (F.col("used") - 1) / 2)).otherwise(F.lit(0.0))
        scored = scored.join(F.broadcast(used) if used.count() <= BROADCAST else used, "qid").withColumn("proximity", share)
    else:
        scored = scored.withColumn("proximity", F.lit(0.0))
    if config.static_weight > 0:
        scored = scored.join(index.chunk_stats.select("chunk_id", "g"), "chunk_id")
    else:
        scored = scored.withColumn("g", F.lit(0.0))
    return scored.select("qid", "chunk_id", "base", "proximity", "g")


def answered(docs: DataFrame, queries: DataFrame, asked: list[tuple[IndexConfig, SearchConfig]]) -> list[tuple[DataFrame, int]] | None:
    """What search gives for each pair of an index of docs (unique, written) and a search, and the chunks of that index, from two
    passes over all docs whatever their number; None where the batch is too large or a setting is none that batch.py serves."""
    if not all(batch.serves(c) and s.proximity_weight >= 0 and s.static_weight == 0 for c, s in asked):
        return None
    terms = {a: written(analyze(queries.select("qid", "text"), ["qid"], "text", a), "query-terms") for a in {c.analyzer for c, _ in asked}}
    if max(t.count() for t in terms.values()) > BROADCAST:
        return None
    configs = list(dict.fromkeys(c for c, _ in asked))
    made, facts = batch.stats(docs, configs, {a: [r.term for r in t.select("term").distinct().collect()] for a, t in terms.items()})
    indexes = [Index(c, None, None, stats, None, None, n, total / max(n, 1)) for c, (n, total, stats) in zip(configs, facts, strict=True)]
    vectors: dict[tuple, DataFrame] = {}
    groups: dict[tuple, list[SearchConfig]] = {}  # searches that share their base scores
    for c, s in asked:
        key = (configs.index(c), s.eliminate)
        if key not in vectors:
            vectors[key] = written(query_vector(indexes[key[0]], terms[c.analyzer], ["qid"], s.eliminate).withColumn("used", F.count("*").over(Window.partitionBy("qid"))), "queries")
        groups.setdefault((*key, bool(s.champions and c.champions), s.method, *((s.k1, s.b) if s.method == "bm25" else ())), []).append(s)
    rows = {key: v.collect() for key, v in vectors.items()}
    whole = lambda own: SearchConfig(method=own[0].method, k1=own[0].k1, b=own[0].b, proximity_weight=max(s.proximity_weight for s in own))
    plain = [k for k in groups if not k[2]]
    listed = list(dict.fromkeys(k[0] for k in groups if k[2]))
    scorings = [batch.scoring(configs[k[0]], whole(groups[k]), max(s.k for s in groups[k]), indexes[k[0]].avg_length, rows[k[:2]]) for k in plain]
    lists = [batch.scoring(configs[i], SearchConfig(), 1, 1.0, next(r for k, r in rows.items() if k[0] == i)) for i in listed]
    found = written(batch.scored(made, scorings, lists), "found")
    left: dict[tuple, DataFrame] = {}
    for k, own in groups.items():
        s, used = whole(own), F.broadcast(vectors[k[:2]].select("qid", "used").distinct())
        if k[2]:
            i = k[0]
            held = found.filter(F.col("s") == -1 - listed.index(i)).withColumnRenamed("qid", "term")
            indexes[i].champions = written(champions_of(held.withColumn("positions", F.lit(None)), indexes[i].term_stats, configs[i].zone_weight, configs[i].champions), "champions")
            base = term_scores(indexes[i], F.broadcast(vectors[k[:2]]), SearchConfig(method=s.method, k1=s.k1, b=s.b, champions=True)).groupBy("qid", "chunk_id").agg(F.sum("w").alias("base"), F.count("*").alias("matched"))
            left[k] = reaching(base, max(c.k for c in own), s.proximity_weight, 0.0)  # not all terms are champions' terms
        else:
            base = found.filter(F.col("s") == plain.index(k)).select("qid", "chunk_id", "base", "matched").join(used, "qid")
            left[k] = reaching(base, max(c.k for c in own), s.proximity_weight, 0.0)
        left[k] = left[k].select(F.lit(list(groups).index(k)).alias("g"), "qid", "chunk_id", "base", "matched").join(used, "qid")
    chosen = written(reduce(DataFrame.unionByName, left.values()), "reaching")
    near = [i for i, own in enumerate(groups.values()) if max(s.proximity_weight for s in own) > 0]
    v_of = {i: list(vectors).index(k[:2]) for i, k in enumerate(groups)}
    windows = sorted({s.proximity_window for own in groups.values() for s in own if s.proximity_weight > 0})
    close = None
    if near:
        asked_of = [{} for _ in vectors]
        for v, r in zip(asked_of, rows.values(), strict=True):
            for x in r:
                v.setdefault(x.qid, []).append(x.term)
        number = F.element_at(F.create_map(*[F.lit(x) for i in near for x in (i, v_of[i])]), F.col("g"))
        pairs = chosen.filter(F.col("g").isin(near) & (F.col("matched") >= 2)).select(number.alias("v"), "qid", "chunk_id").distinct()
        close = written(batch.closeness(docs, pairs, asked_of, [configs[k[0]] for k in vectors], windows), "close")
    out = []
    for c, s in asked:
        k = next(k for k, own in groups.items() if k[:2] == (configs.index(c), s.eliminate) and any(s is x for x in own))
        i = list(groups).index(k)
        mine = chosen.filter(F.col("g") == i).drop("g")
        if s.proximity_weight > 0:
            mine = mine.join(close.filter((F.col("v") == v_of[i]) & (F.col("window") == s.proximity_window)).select("qid", "chunk_id", "close"), ["qid", "chunk_id"], "left")
            mine = mine.withColumn("proximity", F.when(F.col("matched") >= 2, F.coalesce(F.col("close") / (F.col("used") * (F.col("used") - 1) / 2), F.lit(0.0))).otherwise(F.lit(0.0)))  # another search may have asked for this pair
        else:
            mine = mine.withColumn("proximity", F.lit(0.0))
        mine = mine.withColumn("score", F.col("base") * (1 + s.proximity_weight * F.col("proximity"))).withColumn("g", F.lit(0.0))
        out.append((top(mine, s.k).select("qid", "rank", "chunk_id", "score", "base", "proximity", "g"), indexes[configs.index(c)].n))
    return out


def top(scored: DataFrame, k: int) -> DataFrame:
    """scored with rank: each query's k best rows; ties by chunk id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """qid, rank, chunk_id, score, base, proximity, g of each query's k best chunks; ties by chunk id."""
    score = F.col("base") * (1 + config.proximity_weight * F.col("proximity")) + config.static_weight * F.col("g")
    return top(components(index, queries, config, config.k).withColumn("score", score), config.k).select("qid", "rank", "chunk_id", "score", "base", "proximity", "g")


def parents(ranked: DataFrame) -> DataFrame:
    """qid, rank, doc_id: documents in the order of their first chunk."""
    firsts = ranked.select("qid", "rank", doc_of().alias("doc_id")).groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    return firsts.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("first")).alias("rank"), "doc_id")


def parent_ranking(index: Index, ranked: DataFrame) -> DataFrame:
    """qid, rank, doc_id: documents in the order of their first chunk."""
    return parents(ranked)


def explain(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """qid, term, df, idf, query_weight, postings_processed of the terms a search uses."""
    qvec = query_vector(index, query_terms(index, queries), ["qid"], config.eliminate)
    seen = term_scores(index, qvec, config).groupBy("qid", "term").agg(F.count("*").alias("postings_processed"))
    return qvec.join(seen, ["qid", "term"], "left").select("qid", "term", "df", "idf", F.col("qw").alias("query_weight"), F.coalesce("postings_processed", F.lit(0)).alias("postings_processed"))


def match_count(index: Index, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, n: distinct query terms that a chunk holds."""
    return query_terms(index, queries).select("qid", "term").distinct().join(index.postings.select("term", "chunk_id"), "term").groupBy("qid", "chunk_id").agg(F.count("*").alias("n"))


def contributions(index: Index, queries: DataFrame, ranked: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """qid, chunk_id, term, w: what each query term adds to the base score of each ranked chunk."""
    qvec = query_vector(index, query_terms(index, queries), ["qid"], config.eliminate)
    return term_scores(index, qvec, config).join(ranked.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").select("qid", "chunk_id", "term", "w")
