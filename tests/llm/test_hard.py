"""Every operator and stage on nulls beside great ids, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe, langid, lm, neardup, packing, pii, quality, simhash, substring, topk, urls  # noqa: E402

BIG = 2**60 + 1
TEXTS = ["home " * 20_000, "home | " * 15_000 + "\nA line of prose, which is long enough to be kept and has its point.", "x" * 100_000, None, "", " \n ", "Some few words.", "Some few words.", "a1" * 30_000]
#: Names that operators use for columns of their own, results or helpers.
CLASHING = ("k1", "k2", "_k1", "_key", "nth", "salt", "rank", "hits", "_hits", "_mark", "_left", "_cards", "_words", "_full", "_good", "words", "kept", "clean_text", "n_words", "n_removed", "fp", "sid", "_ranges", "ranges", "block", "held_out", "score", "lang_pred", "n_email", "component_id")


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(BIG + 2 * (i - (i == 7)), t) for i, t in enumerate(TEXTS)] + [(None, "No id at all, but words.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return df.withColumns({c: F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 1) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def ids(hard):
    return sorted([r.doc_id for r in hard.select("doc_id").collect()], key=str)


def found(df):
    return sorted([r.doc_id for r in df.select("doc_id").collect()], key=str)


def whole(df, docs, replaced):
    """Other columns come through as they were."""
    kept = [c for c in docs.columns if c not in replaced and c != "text"]
    as_rows = lambda x: sorted(map(str, x.select(*kept).collect()))
    return as_rows(df) == as_rows(docs)


def every(docs):
    """Each operator over docs: name -> rows of doc_id."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    pieces = langid.pieces_of(P.path("piece_bpe_32k.model"))
    languages, p = langid.train(docs.select("doc_id", "text", F.lit("en").alias("lang")), pieces)
    return {
        "packing": packing.pack_documents(docs, P.path("word_bpe_49k.json")).filter("piece = 0"),
        "simhash": simhash.near_duplicates(docs),
        "langid": langid.predict(docs, pieces, languages, p),
        "pii": pii.pseudonymise(docs, "k"),
        "substring": substring.dedup_substrings(docs, digest=True),
        "bpe": bpe.encode(docs, path, P.PATTERN),
        "lm": lm.score(docs, F.col("doc_id") % 2 == 0),
        "quality": quality.quality(docs),
    }


def test_rows_and_columns_survive(hard, ids):
    out = every(hard)
    for name, df in out.items():
        assert found(df) == ids, name
    assert whole(out["langid"], hard, ("lang_pred", "score"))
    assert whole(out["pii"], hard, [f"n_{k}" for k in pii.KINDS])
    assert whole(out["substring"], hard, ("n_words", "n_removed", "kept_sha256"))
    new = set(out["quality"].columns) - {"doc_id", "text"} - set(hard.columns)
    assert whole(out["quality"], hard, {*new, "kept", "clean_text", "n_words"})
    assert not any(r.kept for r in out["quality"].select("kept").collect())
    assert {r.doc_id: r.n_tokens for r in out["lm"].collect()}[BIG] == 20_001


def test_a_line_of_a_megabyte(spark):
    """No pattern recurses over a text: neither menus nor long runs of what could be a secret, an address or a card."""
    texts = ["home " * 200_000, "home | " * 150_000, "x" * 1_000_000, "a1" * 500_000, "a." * 300_000 + "@" + "b." * 200_000, "1 2 3 4 " * 50_000, "AA00 " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    judged = {r.doc_id: r for r in quality.quality(df).select("doc_id", "n_words", "n_lines_removed").collect()}
    assert judged[0].n_words == 200_000 and judged[0].n_lines_removed == judged[1].n_lines_removed == 1
    assert len(pii.pseudonymise(df, "k").select("text").collect()) == len(texts)


def test_stages_survive(spark, hard):
    import corpus_pipeline as C

    docs = hard.select("*", F.length("text").alias("n_chars"))
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        assert out.count() >= (0 if name == "quality_rules" else 7), name
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
            assert out.filter("k1 <> doc_id + 1").count() == 0, name  # the caller's own values
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_empty_tables(hard):
    none = hard.limit(0)
    for name, df in every(none).items():
        assert df.count() == 0, name
    assert neardup.dedup(none).columns == none.columns and neardup.dedup(none).count() == 0


def test_neardup_keeps_one(hard, ids):
    kept = neardup.dedup(hard)
    assert kept.columns == hard.columns and whole(kept, hard.join(kept.select(F.col("doc_id").alias("d")), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").dropDuplicates(["doc_id"]), ())
    assert found(kept).count(BIG + 12) == 1 and None in found(kept)


def test_vectors(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 2.0], None, [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [1e30, 2.0], [-1e30, 5.0], [1.0, 2.0], [3.0], []])] + [(7, [1.0, 2.0]), (None, [9.0, 9.0]), (20, [1e30, 1.0]), (40, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cell", "sub", "score", "rank")})
    df.write.mode("overwrite").parquet("/tmp/tessera-test-vectors/embeddings.parquet")
    got = topk.op2_topk(spark, "/tmp/tessera-test-vectors").collect()
    finite = [(i, [int(x * 64 // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 1e300 and x == x for x in v)]
    for q in (0, 20, 40):
        mine = next(v for i, v in finite if i == q)
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(mine, v, strict=False)))), i) for i, v in finite if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == scores


def test_elimination(spark):
    """On clustered vectors most block pairs never meet, and the result is exact."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(24, 32)) * 400
    vecs = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(24 * 60, 32)) * 10)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, vector array<double>")
    report: dict = {}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, pivots=24, block=64, report=report).collect()
    assert 0 < report["met"] < report["all"] / 2
    for q in range(0, len(vecs), 20):
        want = sorted((-int(vecs[q] @ vecs[i]), i) for i in range(len(vecs)) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_pages(spark):
    rows = [(1, "http://evil.org/p"), (2, "https://www.evil.org:8080/p/?q#x"), (2, "https://www.evil.org:8080/p/?q#x"), (3, None), (4, "none"), (5, "http://good.org/" + "a/" * 500_000), (None, "http://Evil.org/q"), (BIG, "http://a.net/"), (6, ""), (7, "http:///p")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(5) for c in ("_key", "_hit", "_best", "key", "block", "host", "rule")})
    listed = spark.createDataFrame([("http://evil.org/p",), ("http://evil.org/p",), (None,), ("junk",), ("http:///p",)], "url string")
    got = sorted([(str(r.page_id), r.host, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.RULES, listed).collect()])
    want = [("1", "evil.org", None, "block"), ("2", "www.evil.org:8080", None, "block"), ("2", "www.evil.org:8080", None, "block"), ("3", "", None, "allow"), ("4", "", None, "allow"), ("5", "good.org", None, "allow"), ("None", "evil.org", None, "allow"), (str(BIG), "a.net", "net/", "block"), ("6", "", None, "allow"), ("7", "", None, "allow")]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert urls.filter_urls(pages, (), None).filter("verdict <> 'allow'").count() == 0
    assert urls.filter_urls(pages.limit(0), urls.RULES, listed).count() == urls.filter_urls(pages.limit(0), (), listed.limit(0)).count() == 0


def test_crowded_fingerprints(spark):
    """Keys over HUGE become stars of shared points; their components are those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    while len(fps) < 120:
        x = base
        for b in rng.integers(0, 24, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    v = np.array(sorted(fps), np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))
    want = simhash.roots(len(v), a, b)
    df = spark.createDataFrame([(int(x),) for x in v], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, hot=16, huge=32)).collect()}
    assert [got.get(int(x), int(x)) for x in v] == [int(v[r]) for r in want]
