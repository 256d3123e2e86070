"""Corpora, queries and judgements from files, and raw files made into a corpus."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("ticker", "company", "filing_type", "period", "source_url")
FINANCE_KEYS = ("ticker", "filing_type", "period")
CORPUS_SCHEMA = "_id STRING, title STRING, text STRING, " + ", ".join(f"{m} STRING" for m in META)
QUERY_SCHEMA = "_id STRING, text STRING, metadata MAP<STRING, ARRAY<STRUCT<sentences: ARRAY<INT>, label: STRING>>>"
#: Ingested files are cut to so many characters; rows of a CSV file are not.
FILE_CHARS = 50_000


def corpus_of(rows: DataFrame) -> DataFrame:
    """doc_id, title, text and metadata of rows that name their id _id, doc_id or id; rows without id or text go."""
    ids = [F.col(c).cast("string") for c in ("_id", "doc_id", "id") if c in rows.columns]
    title = F.coalesce("title", F.lit("")) if "title" in rows.columns else F.lit("")
    found = rows.select(F.coalesce(*ids).alias("doc_id"), title.alias("title"), "text", *[m for m in META if m in rows.columns])
    return found.filter("coalesce(doc_id, '') <> '' AND coalesce(text, '') <> ''")


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A corpus in JSON lines (_id, title, text and optional metadata)."""
    return corpus_of(spark.read.schema(CORPUS_SCHEMA).json(path))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text, metadata of queries in JSON lines; metadata maps documents to entries of sentences and a label."""
    return spark.read.schema(QUERY_SCHEMA).json(path).select(F.col("_id").alias("qid"), "text", F.coalesce("metadata", F.create_map().cast("map<string,array<struct<sentences:array<int>,label:string>>>")).alias("metadata"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, score of judgements in tab-separated lines under a header; of repeated pairs the greatest score."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="qid STRING, doc_id STRING, score STRING")
    return rows.groupBy("qid", "doc_id").agg(F.max(F.col("score").cast("double").cast("int")).alias("score"))


def is_finance(docs: DataFrame) -> bool:
    """Whether any of the first five documents has a ticker, a filing type or a period."""
    keys = [k for k in FINANCE_KEYS if k in docs.columns]
    return any(v is not None for r in docs.select(*keys).limit(5).collect() for v in r) if keys else False


def surrogate_id(path: Column, text: Column) -> Column:
    return F.concat(F.lit("FIN_"), F.upper(F.substring(F.sha1(F.concat(path, F.substring(text, 1, 200))), 1, 8)))


@dataclass(frozen=True)
class Defaults:
    """Metadata for files that bring none."""

    ticker: str = "UNKNOWN"
    company: str = ""
    filing_type: str = "UNKNOWN"
    period: str = "UNKNOWN"
    source_url: str = ""


def _pdf_text(data: bytes) -> str:
    """The pages of a PDF file; nothing where no reader is installed or the file is broken."""
    try:
        from pypdf import PdfReader

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    except Exception:  # a broken file must not stop the others
        return ""


def _file_rows(path: str, data: bytes, defaults: Defaults) -> Iterator[tuple]:
    base = path.rsplit("/", 1)[-1]
    new_id = lambda text: "FIN_" + hashlib.sha1((path + text[:200]).encode()).hexdigest()[:8].upper()
    given = {m: getattr(defaults, m) for m in META} | {"source_url": defaults.source_url or path}
    text = _pdf_text(data) if base.lower().endswith(".pdf") else data.decode("utf-8", "replace")
    if base.lower().endswith(".csv"):
        rows = csv.DictReader(io.StringIO(text, newline=""))
        if "text" in (rows.fieldnames or ()):
            for r in rows:
                if r.get("text"):
                    yield r.get("_id") or new_id(r["text"]), r.get("title") or base, r["text"], *[r.get(m) or given[m] for m in META]
            return
    if text.strip():
        yield new_id(text), base.rsplit(".", 1)[0].replace("_", " ").title(), text[:FILE_CHARS], *given.values()


def ingest(spark: SparkSession, folder: str, defaults: Defaults = Defaults()) -> DataFrame:
    """A corpus (_id, title, text, metadata) from the text, Markdown, CSV and PDF files below a folder.

    A CSV file with a column text gives one document a row, any other file one document. Each file has its own header, so
    files are parsed one by one, on the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,csv,pdf}").load(folder)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", "title", "text", *META]
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(_file_rows(path, data, defaults)), columns=names)

    return files.select("path", "content").mapInPandas(parsed, CORPUS_SCHEMA)
