import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import analyze, analyze_text
from tessera.operators import boolean as B
from tessera.operators import evaluate as E
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.operators import verify as V
from tessera.plans.config import AnalyzerConfig, IndexConfig, SearchConfig


@pytest.fixture(scope="module")
def index(spark):
    docs = [("a", "red fox", "The red fox runs. It likes cold rivers.", "en"), ("b", "blue fish", "A blue fish swims in cold rivers.", "en"), ("c", "nichts", "Ein Fuchs.", "de")]
    return I.build(spark.createDataFrame(docs, "doc_id string, title string, text string, lang string"), IndexConfig(strategy="whole", champions=1))


def ids(df):
    return sorted(r.chunk_id for r in df.collect())


def test_postings_and_stats(index):
    row = index.postings.filter("term = 'fox'").first()
    assert (row.chunk_id, row.tf, row.tf_title, row.positions) == ("a#0", 2, 1, [1, 1001])
    assert index.n == 3
    assert index.term_stats.filter("term = 'river'").first().idf == pytest.approx(math.log(3 / 2))
    assert index.chunk_stats.filter("norm <= 0").count() == 0


def test_save_and_load(index, tmp_path):
    index.save(str(tmp_path / "x"))
    again = I.Index.load(index.spark, str(tmp_path / "x"))
    assert again.config == index.config and again.n == 3 and again.postings.count() == index.postings.count()


@pytest.mark.parametrize(
    "query,want",
    [
        ("fox", ["a#0"]),
        ("cold AND fish", ["b#0"]),
        ("fox OR fish", ["a#0", "b#0"]),
        ("NOT river", ["c#0"]),
        ('"cold rivers"', ["a#0", "b#0"]),
        ('"rivers cold"', []),
        ('"fox unknownword"', ["a#0"]),
        ('"the"', []),
        ("the", ["a#0", "b#0", "c#0"]),
        ("title:fox", ["a#0"]),
        ("body:blue", ["b#0"]),
        ("lang:DE", ["c#0"]),
        ("(fox OR fish", ["a#0", "b#0"]),
        ("fox NOT river", ["a#0"]),
        ("", []),
    ],
)
def test_boolean(index, query, want):
    assert ids(B.boolean(index, query)) == want


def test_ranking(index, spark):
    q = spark.createDataFrame([("1", "red fox in cold rivers"), ("2", "unknownword")], "qid string, text string")
    rows = S.search(index, q).orderBy("qid", "rank").collect()
    assert [(r.qid, r.chunk_id) for r in rows] == [("1", "a#0"), ("1", "b#0")]
    assert 0 <= rows[0].proximity <= 1 and rows[0].score > rows[0].base
    assert {(r.qid, r.term) for r in S.eliminated(index, S.query_terms(index, q)).collect()} == {("2", "unknownword")}
    for c in (SearchConfig(method="bm25"), SearchConfig(champions=True), SearchConfig(static_weight=0.2)):
        assert S.search(index, q, c).filter("rank = 1").first().chunk_id == "a#0"


def test_verdicts(index, spark):
    claims = spark.createDataFrame([("1", "The red fox runs"), ("2", "A blue fish runs")], "qid string, text string")
    top = S.search(index, claims)
    got = {r.cid: r for r in V.verify_claims(index, claims.withColumnRenamed("qid", "cid"), top).collect()}
    assert got["1"].verdict == "SUPPORTED" and got["1"].support > got["2"].support
    said = V.answer(index, top, claims)
    checked = V.verify_answer(index, said.select("qid", F.col("turn").alias("pos"), "text", F.array(F.col("rank").cast("bigint")).alias("citations")), top)
    assert checked.count() == said.count() > 0


def test_metrics(spark):
    ranking = spark.createDataFrame([("1", 1, "x"), ("1", 2, "y"), ("1", 3, "z"), ("2", 1, "x")], "qid string, rank int, doc_id string")
    qrels = spark.createDataFrame([("1", "y"), ("1", "z"), ("2", "q")], "qid string, doc_id string")
    got = {r.qid: r for r in E.query_metrics(ranking, qrels).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["1"].ndcg == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    assert (got["1"].mrr, got["1"].p5, got["1"].r100) == (0.5, 0.4, 1.0) and got["1"].ap == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got["2"].ndcg == got["2"].mrr == 0
    parts = {r.qid: r.part for r in E.split_qids(spark.createDataFrame([("10",), ("9",), ("x",)], "qid string")).collect()}
    assert parts == {"9": "dev", "10": "test", "x": "test"}


def test_threshold(spark):
    items = spark.createDataFrame([(0.9, True), (0.4, True), (0.2, False)], "score double, gold boolean")
    best = E.best_threshold(E.threshold_sweep(items)).first()
    assert best.f1 == 1 and best.threshold == 0.25


def test_verifier_evaluation(index, spark):
    from tessera.operators import verifier_eval as VE

    queries = spark.createDataFrame([("1", "The red fox runs", {"a": [([0], "SUPPORT")]}), ("2", "A blue fox runs along rivers", {"b": [([0], "CONTRADICT")], "zz": [([1], "CONTRADICT")]}), ("3", "cold", {})], "qid string, text string, metadata map<string,array<struct<sentences:array<int>,label:string>>>")
    evidence = VE.evidence_of(queries)
    items = VE.items(queries, evidence)
    assert sorted((r.qid, r.doc_id or "", r.label) for r in items.collect()) == [("1", "a", "SUPPORT"), ("2", "b", "CONTRADICT"), ("2", "zz", "CONTRADICT"), ("3", "", "NEI")]
    ranked = S.search(index, queries)
    got = {(r.qid, r.doc_id): r for r in VE.scores(index, items, ranked).collect()}
    assert len(got) == 4
    # red fox run of red, fox, run, like, cold, river
    assert got["1", "a"].jaccard == pytest.approx(3 / 6) and got["1", "a"].penalty == 0 and got["1", "a"].cosine > got["2", "b"].cosine
    assert (got["2", "zz"].cosine, got["2", "zz"].jaccard) == (0, 0) and got["3", None].cosine > 0
    assert VE.best_penalty(VE.penalty_grid(VE.scores(index, items, ranked))).first().f1 == 1
    hits = VE.hit_at_k(index, items, ranked).first()
    assert hits.n == 3 and hits.hit5 == pytest.approx(2 / 3)
    recall = VE.evidence_recall(index, items, evidence, ranked, spark.createDataFrame([("1", "The red fox runs.")], "qid string, text string")).first()
    assert (recall.n, recall.baseline, recall.answer) == (1, 1, 1)
    m = VE.binary_metrics(spark.createDataFrame([(0.9, True), (0.8, False), (0.1, True), (0.0, False)], "s double, gold boolean"), "s", 0.5).first()
    assert (m.precision, m.recall, m.f1, m.accuracy, m.n) == (0.5, 0.5, 0.5, 0.5, 4)


def test_holding(spark):
    from tessera.plans.queries import holding

    docs = spark.createDataFrame([("1", "xa b c d cy"), ("2", "a b"), ("3", "nothing"), ("4", "")], "doc_id string, text string")
    heads = spark.createDataFrame([("p", "a b c d c"), ("q", "a b"), ("r", "a c d c"), ("s", "c"), ("t", "b c d")], "qid string, text string")
    assert sorted((r.qid, r.doc_id) for r in holding(docs, heads).collect()) == [("p", "1"), ("q", "1"), ("q", "2"), ("s", "1"), ("t", "1")]


def test_trace(index):
    assert [(r.node, r.n) for r in B.trace(index, '"cold rivers" AND title:fox').orderBy("step").collect()] == [
        ('"cold rivers"', 2), ("title:fox", 1), ('order title:fox -> "cold rivers"', 2), ("AND", 1),
    ]
    assert [(r.node, r.n) for r in B.trace(index, "NOT (fox OR fish)").orderBy("step").collect()] == [("fox", 1), ("fish", 1), ("OR", 2), ("NOT", 1)]


def test_whole_claims(spark):
    """Claims and searches of whole items against SQL: words after the twelfth count."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans.oracles import ORACLES
    from tessera.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    for name in ("search_tfidf", "claim_cosine", "verify_claims", "verifier_scores", "tune_penalty"):
        got = QUERIES[name](spark, sf_dir)
        want = con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        rows = lambda found: sorted([[round(float(x), 5) if isinstance(x, float) else str(x) for x in r] for r in found], key=str)
        a, b = rows(got.select(*columns).collect()), rows(want.fetchall())
        assert len(a) == len(b) > 0, name
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-5) if all(isinstance(v, float) for v in x) else [str(v) for v in x] == [str(v) for v in y], name
    early = {str(r.qid): set(analyze_text(" ".join(r.w[:12]))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id qid", "split(text, ' ') w").collect()}
    assert any(set(r.novel.split()) - early[r.cid] for r in QUERIES["claim_cosine"](spark, sf_dir).collect())


def test_postfix():
    """The grammar's traps: what follows an operand without an operator is AND, a stray NOT or parenthesis ends the query."""
    show = lambda q: " ".join(f"<{x}>" if isinstance(x, str) else str(x) or "()" for x in B.postfix(q))
    for query, want in {
        "a NOT b": "a", "(a NOT b) c": "a", "foo) bar": "foo", "a b OR c": "a b <AND> c <OR>", "a OR b c": "a b c <AND> <OR>", 'NOT (a OR b) AND "x (y) z"': 'a b <OR> <NOT> "x (y) z" <AND>',
        "a AND": "a () <AND>", "( ) a": ") a <AND>", "a AND OR b": "a OR <AND> b <AND>", "": "()", "(fox OR fish": "fox fish <OR>", "x OR NOT NOT y z": "x y <NOT> <NOT> z <AND> <OR>", 'Title:"foo" lang:de not': 'title:"foo" lang:de <AND> not <AND>',
    }.items():
        assert show(query) == want, query


def test_analyze_text(spark):
    """The driver's analyser says what the workers say."""
    texts = ["Éçan ﬁne Žluťoučký running dogs' 10-K Q3 $81.8 billion", "the NOT against", "", None, "Straße ＡＢＣ x²"]
    for finance in (False, True):
        config = AnalyzerConfig(finance_mode=finance)
        rows = analyze(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"], "text", config).orderBy("k", "pos").collect()
        assert [[r.term for r in rows if r.k == k] for k in range(len(texts))] == [analyze_text(t, config) for t in texts]


def test_search_moves_few_positions(index, spark, monkeypatch):
    """Positions are looked up for chunks that can be among the best alone, and the ranking is that over all chunks."""
    from pyspark.sql import functions as F

    from tessera.operators import search as S
    from tessera.plans.config import SearchConfig

    base = spark.createDataFrame([("q", f"c{i}", float(i), 2) for i in range(100)] + [("p", "c1", 0.5, 2)], "qid string, chunk_id string, base double, matched long")
    kept = {(r.qid, r.chunk_id) for r in S.reaching(base, 10, 0.5, 0.0).collect()}
    assert kept == {("q", f"c{i}") for i in range(60, 100)} | {("p", "c1")}  # 60 * 1.5 is the tenth base
    assert len(S.reaching(base, 10, 0.5, 30.0).collect()) == 61  # from 40 on

    assert len(S.reaching(base.withColumn("used", F.lit(20)), 10, 0.5, 0.0).collect()) == 11  # two of twenty terms are one of 190 pairs

    words = [r.term for r in index.term_stats.filter("df > 1").orderBy("term").limit(3).collect()]
    queries = spark.createDataFrame([("q", " ".join(words))], "qid string, text string")
    config = SearchConfig(k=2, static_weight=0.1)
    score = F.col("base") * (1 + 0.5 * F.col("proximity")) + 0.1 * F.col("g")
    every = S.top(S.components(index, queries, config).withColumn("score", score), 2).select("qid", "rank", "chunk_id")
    assert sorted(S.search(index, queries, config).select("qid", "rank", "chunk_id").collect()) == sorted(every.collect())


def test_postings_stay_where_they_are_made(spark):
    from tessera.operators.index import build, postings_of
    from tessera.plans.config import IndexConfig

    docs = spark.createDataFrame([(str(i), "t", f"word{i} and others come here. More of them follow.") for i in range(20)], "doc_id string, title string, text string")
    x = build(docs, IndexConfig(champions=2), keep=False)
    assert "Exchange" not in postings_of(x.chunks, x.config)._jdf.queryExecution().executedPlan().toString()
    kept = build(docs, IndexConfig(champions=2))
    for name in ("chunk_stats", "champions"):
        rows = [sorted(map(str, getattr(i, name).collect())) for i in (x, kept)]
        assert rows[0] == rows[1] and rows[0]
