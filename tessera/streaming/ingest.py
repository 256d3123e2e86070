"""A corpus that arrives as a stream of JSON-lines files, added to chunk and posting tables batch by batch.

Chunks and postings depend on their own document alone, so a batch is written by itself, in a folder named by its number: a
batch that is run again after a failure writes the same folder, and nothing counts twice. Statistics depend on the whole
corpus and are computed when the tables are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import index as I
from tessera.operators.chunking import chunk
from tessera.plans.config import IndexConfig
from tessera.sources.readers import CORPUS_SCHEMA, corpus_of


def corpus_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return corpus_of(spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder))


def index_stream(docs: DataFrame, target: str, checkpoint: str, config: IndexConfig = IndexConfig()) -> StreamingQuery:
    """Adds what docs brings to the tables below target, and stops when all that is there has been read."""

    def add(batch: DataFrame, number: int) -> None:
        where = f"batch={number}"
        chunk(batch.dropDuplicates(["doc_id"]), config).write.mode("overwrite").parquet(f"{target}/chunks/{where}")
        written = batch.sparkSession.read.parquet(f"{target}/chunks/{where}")
        I.clustered(I.postings_of(written, config)).write.mode("overwrite").parquet(f"{target}/postings/{where}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_index(spark: SparkSession, target: str, config: IndexConfig = IndexConfig()) -> I.Index:
    """The index of all batches; of a document that came in several batches the last counts."""
    chunks, postings = (spark.read.parquet(f"{target}/{t}").withColumn("batch", F.col("batch").cast("bigint")) for t in ("chunks", "postings"))
    last = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    current = chunks.join(last, ["doc_id", "batch"], "left_semi")
    held = postings.join(current.select("chunk_id", "batch"), ["chunk_id", "batch"], "left_semi")
    return I.indexed(current.drop("batch"), held.drop("batch"), config)
