"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, pseudonyms, packing.

Each stage reads what the one before kept (as Parquet) and returns the columns of documents, but for the last, which
returns the packed pieces.

Defined cases, in every stage: null and empty texts, repeated rows, empty tables and texts of any length as the stage's
operator defines them; other columns pass through unchanged, whatever their names, as they travel in one struct (n_chars, if
there, follows the text); the last stage takes doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, written
from tessera.llm.neardup import dedup
from tessera.llm.packing import pack_documents
from tessera.llm.pii import key_of, pseudonymise
from tessera.llm.quality import quality
from tessera.llm.substring import dedup_substrings


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the whole row as doc: no column of docs can meet a name of an operator's."""
    return docs.select("doc_id", "text", F.struct("*").alias("doc"))


def _unboxed(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs from doc, with a new text; n_chars follows it."""

    def column(c: str, kind) -> Column:
        new = {"text": text, "n_chars": F.length(text)}.get(c)
        return (F.col("doc").getField(c) if new is None else new.cast(kind)).alias(c)

    return [column(f.name, f.dataType) for f in docs.schema]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail; null and empty texts fail."""
    # a filter would be pushed below the rules, which Spark then writes out again for each use; a generator stays above
    passed = F.explode(F.when(F.col("kept"), F.array(F.struct(*_unboxed(docs, F.col("clean_text"))))))
    return quality(_boxed(docs)).select(passed.alias("d")).select("d.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of 0.8 or more of five-word shingles)."""
    return dedup(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; one of which nothing is left stays, empty."""
    return dedup_substrings(_boxed(docs)).select(*_unboxed(docs, F.col("text")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, under the session's key."""
    return pseudonymise(_boxed(docs), key_of(spark)).select(*_unboxed(docs, F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, with their token ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]
#: Fingerprints and tokenisers are beyond SQL; tests/llm/test_reference.py works out the rows in plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage needed goes when its result stands
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
