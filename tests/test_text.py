import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.stemmer import marked, stem
from tessera.operators.chunking import chunk, finance_sentences, fixed_spans
from tessera.plans.config import AnalyzerConfig, IndexConfig

PORTER = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit electriciti electr hopeful hope goodness good adoption adopt probate probat rate rate cease ceas controlling control roll roll s  is i".replace("s  is", "s - is").split()


@pytest.mark.parametrize("word,want", list(zip(PORTER[::2], PORTER[1::2], strict=True)))
def test_porter(word, want):
    assert stem(word) == ("" if want == "-" else want)


def test_consonant_y():
    assert marked("yyysky") == "YyYsky"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_normalize(spark):
    assert one(spark, "Crème-Brûlée, $81.8 Straße_1!", T.normalize) == "creme brulee 81 8 strasse_1"
    assert one(spark, "10-K: $81.8 30%", lambda c: T.normalize(c, True)) == "10-k $81 8 30%"
    assert one(spark, None, T.normalize) == ""


def test_tokens_keep_negators(spark):
    assert one(spark, "This is not the end", T.tokens) == ["not", "end"]
    assert one(spark, "up and down", lambda c: T.tokens(c, AnalyzerConfig(finance_mode=True))) == ["up", "down"]


def test_sentences(spark):
    assert one(spark, "One. Two! (three) 4? five. 6", T.sentences) == ["One.", "Two!", "(three) 4? five.", "6"]
    assert one(spark, "  ", T.sentences) == []


def test_abbreviations_and_tables(spark):
    assert one(spark, "Acme Corp. Sold it. Next\na | b. C", finance_sentences) == ["Acme Corp. Sold it.", "Next", "a | b. C"]


def test_fixed_spans_end_with_a_carry_over():
    assert fixed_spans([60, 60, 20, 20], 120, 30) == [(0, 2, 120), (1, 4, 100)]
    assert fixed_spans([200], 120, 30) == [(0, 1, 200)]
    assert fixed_spans([100, 20], 120, 30) == [(0, 2, 120)]
    assert fixed_spans([], 120, 30) == []


def test_windows(spark):
    text = " ".join(f"S{i}." for i in range(6))
    docs = spark.createDataFrame([("d", "t", text), ("e", "t", "")], "doc_id string, title string, text string")
    rows = {r.chunk_id: (r.text, r.sentence_start, r.sentence_end) for r in chunk(docs, IndexConfig()).collect()}
    assert rows == {"d#0": ("S0. S1. S2.", 0, 3), "d#1": ("S2. S3. S4.", 2, 5), "d#2": ("S4. S5.", 4, 6), "e#0": ("", 0, 0)}


def test_citations(spark):
    assert one(spark, "So it is [3][9].", lambda c: T.citations(c, 5)) == [3]
    assert one(spark, "So it is.", lambda c: T.citations(c, 5)) == [1]
