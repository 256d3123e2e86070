"""Batches answered from the documents give what the tables of an index give."""

from dataclasses import replace

import pytest

from tessera.operators import batch as T
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.operators import tuning as TU
from tessera.plans.config import AnalyzerConfig, IndexConfig, SearchConfig

WORDS = ["Fox", "river", "rivers", "cold", "Straße", "été", "été", "running", "the", "not", "x_1", "blue"]


def _text(i: int) -> str:
    words = [WORDS[(i * 7 + j * (1 + i % 3)) % len(WORDS)] for j in range(5 + i % 40)]
    return " ".join(w + (". " if j % 4 == 3 else "") for j, w in enumerate(words)) + ("\x00 End." if i % 5 == 0 else "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(str(i), _text(i + 1)[:20] if i % 4 else "", _text(i)) for i in range(60)] + [("blank", "", " \n"), ("copy", "", _text(3))]
    return T.unique(spark.createDataFrame(rows, "doc_id string, title string, text string"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("1", "cold rivers not blue"), ("2", "the fox running in the straße"), ("3", "été x_1 rivers fox"), ("4", "unknown")], "qid string, text string")


def rows(df):
    return sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9), round(r.proximity, 9)) for r in df.collect())


def test_batches_give_what_indexes_give(docs, queries):
    ways = [IndexConfig(champions=3), IndexConfig(strategy="whole", zone_weight=1.0), IndexConfig(strategy="fixed", size=12, overlap=5), IndexConfig(sentences=2, step=1, analyzer=AnalyzerConfig(stemming=False))]
    tried = [SearchConfig(k=5, proximity_weight=0.0), SearchConfig(k=5, proximity_window=3), SearchConfig(k=40, method="bm25", proximity_weight=0.0), SearchConfig(k=5, champions=True)]
    asked = [(c, replace(s)) for c in ways for s in tried]
    indexes = {c: I.build(docs, c) for c in ways}
    for (c, s), (ranked, n) in zip(asked, S.answered(docs, queries, asked), strict=True):
        assert n == indexes[c].n
        assert rows(ranked) == rows(S.search(indexes[c], queries, s)), (c, s)


def test_ablation_cuts_documents_once(spark, docs, queries, monkeypatch):
    """every index of the ladder was built anew, with a row for each posting."""
    monkeypatch.setattr(TU, "build", None)
    qrels = spark.createDataFrame([("1", "3"), ("3", "5")], "qid string, doc_id string")
    assert TU.ablation(docs, queries, qrels).count() == 8


def test_chunk_ablation_cuts_documents_once(spark, docs, queries, monkeypatch):
    """so was every index of a way to chunk."""
    monkeypatch.setattr(TU, "build", None)
    qrels = spark.createDataFrame([("1", "3"), ("3", "5")], "qid string, doc_id string")
    assert {r.strategy: r.chunks for r in TU.chunk_ablation(docs, queries, qrels).collect()}["whole"] == 61
