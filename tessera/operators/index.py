"""The index as tables: chunks, positional postings, term and chunk statistics, champion lists."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import stems_of, tokens
from tessera.operators.chunking import chunk
from tessera.plans.config import AnalyzerConfig, IndexConfig
from tessera.plans.storage import written

#: Body positions begin here; a title's terms lie below.
TITLE_GAP = 1000
#: A term's postings lie in so many files at most.
SPREAD = 16
#: Terms up to which their statistics are broadcast.
TERMS = 500_000
POSTINGS = pa.schema([("term", pa.string()), ("chunk_id", pa.string()), ("tf", pa.int64()), ("tf_title", pa.int64()), ("positions", pa.list_(pa.int32())), ("length", pa.int64()), ("norm", pa.float64())])
TABLES = ("chunks", "postings", "term_stats", "chunk_stats", "champions")


def effective_tf(zone_weight: float) -> Column:
    return F.col("tf") + (zone_weight - 1.0) * F.col("tf_title")


def postings_of(chunks: DataFrame, config: IndexConfig) -> DataFrame:
    """term, chunk_id, tf, tf_title, positions, length, norm: one row for each term of each chunk, with the chunk's terms and the
    length of its weight vector. A chunk has all that its postings need, so nothing is shuffled."""
    analyzer, zone = config.analyzer, config.zone_weight - 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stems_of(analyzer.finance_mode) if analyzer.stemming else None
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("term", "chunk_id", "tf", "tf_title", "positions", "length", "norm")}
            for chunk_id, title, body in zip(*[batch.column(c).to_pylist() for c in ("chunk_id", "title", "body")], strict=True):
                places: dict[str, list[int]] = defaultdict(list)
                for begin, words in ((0, title), (TITLE_GAP, body)):
                    for p, w in enumerate(words, begin):
                        places[known[w] if known is not None else w].append(p)
                titled = [sum(p < TITLE_GAP for p in ps) for ps in places.values()]  # a title of over TITLE_GAP terms counts below the gap only
                square = sum((1 + math.log(len(ps) + zone * t)) ** 2 for ps, t in zip(places.values(), titled, strict=True))
                cols["term"] += places
                cols["tf"] += map(len, places.values())
                cols["tf_title"] += titled
                cols["positions"] += map(sorted, places.values())
                for name, value in (("chunk_id", chunk_id), ("length", len(title) + len(body)), ("norm", math.sqrt(square))):
                    cols[name] += [value] * len(places)
            yield pa.RecordBatch.from_pydict(cols, POSTINGS)

    words = chunks.select("chunk_id", tokens(F.col("title"), analyzer).alias("title"), tokens(F.col("text"), analyzer).alias("body"))
    return words.mapInArrow(run, "term string, chunk_id string, tf long, tf_title long, positions array<int>, length long, norm double")


def clustered(postings: DataFrame) -> DataFrame:
    """Postings sorted by term, a term being dealt over SPREAD tasks at most, so that lookups skip row groups."""
    return postings.repartition(F.col("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).sortWithinPartitions("term", "chunk_id")


@dataclass
class Index:
    config: IndexConfig
    chunks: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    chunk_stats: DataFrame
    champions: DataFrame
    n: int
    avg_length: float

    @property
    def idf_max(self) -> float:
        return math.log(max(self.n, 2))

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def save(self, path: str) -> None:
        """Parquet tables, postings clustered by term so that lookups skip row groups, and the settings as JSON."""
        for name in TABLES:
            df = getattr(self, name)
            (clustered(df) if name == "postings" else df).write.mode("overwrite").parquet(f"{path}/{name}")
        facts = {"config": asdict(self.config), "n": self.n, "avg_length": self.avg_length}
        self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        own = facts["config"] | {"analyzer": AnalyzerConfig(**facts["config"]["analyzer"])}
        return cls(IndexConfig(**own), *[spark.read.parquet(f"{path}/{t}") for t in TABLES], facts["n"], facts["avg_length"])


def term_stats_of(postings: DataFrame, n: int) -> DataFrame:
    df = F.col("df")
    return postings.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.log(F.lit(float(n)) / df).alias("idf"), F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("bm25_idf"))


def chunk_stats_of(postings: DataFrame, term_stats: DataFrame, n: int) -> DataFrame:
    """length, title_length, norm and static quality g of each indexed chunk."""
    body, title = F.col("tf") > F.col("tf_title"), F.col("tf_title") > 0
    rich = lambda zone: F.coalesce(F.avg(F.when(zone, F.col("idf"))), F.lit(0.0)) / math.log(max(n, 2))
    return postings.drop("positions").join(term_stats.select("term", "idf"), "term").groupBy("chunk_id").agg(
        F.max("length").alias("length"), F.sum("tf_title").alias("title_length"), F.max("norm").alias("norm"), (0.5 * rich(body) + 0.5 * rich(title)).alias("g")
    )


def champions_of(postings: DataFrame, term_stats: DataFrame, zone_weight: float, size: int) -> DataFrame:
    """Each term's size heaviest postings, without positions, by rnk; ties by chunk id. A term's idf scales all its weights
    alike, but for idf 0."""
    everywhere = term_stats.filter("idf <= 0").select(F.col("term").alias("t"))  # terms that all chunks hold
    heavy = F.round(F.log(effective_tf(zone_weight)), 9)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "chunk_id"))
    weighed = postings.drop("positions").join(everywhere, F.col("term") == F.col("t"), "left").withColumn("w", F.when(F.col("t").isNull(), heavy).otherwise(F.lit(0.0))).drop("t")
    return weighed.withColumn("rnk", rank).filter(F.col("rnk") <= size).drop("w")


def build(docs: DataFrame, config: IndexConfig = IndexConfig(), keep: bool = True) -> Index:
    """The index of docs (doc_id string, title, text, meta); of rows with one doc_id, one is indexed. Without keep it is for a
    batch or two: postings stay in the order of chunks, as they are made, so nothing is shuffled and what is summed by chunk is
    nearly summed before any shuffle; the statistics of chunks and the champions are plans, worked out where they are used."""
    unique = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    chunks = written(chunk(unique, config), "chunks")
    made = postings_of(chunks, config)
    return indexed(chunks, written(clustered(made) if keep else made, "postings"), config, keep)


def indexed(chunks: DataFrame, postings: DataFrame, config: IndexConfig, keep: bool = True) -> Index:
    """The index of chunks and their postings: the statistics, and the champions."""
    n, total = postings.groupBy("chunk_id").agg(F.max("length").alias("l")).agg(F.count("*"), F.coalesce(F.sum("l"), F.lit(0))).first()
    terms = written(term_stats_of(postings, n), "terms")
    stats = chunk_stats_of(postings, F.broadcast(terms) if terms.count() <= TERMS else terms, n)
    champions = champions_of(postings if config.champions else postings.limit(0), terms, config.zone_weight, config.champions)
    if keep:
        stats, champions = written(stats, "stats"), written(champions.sortWithinPartitions("term"), "champions")
    return Index(config, chunks, postings, terms, stats, champions, n, total / max(n, 1))


def skip_plan(postings: DataFrame, term_stats: DataFrame) -> DataFrame:
    """term, i, chunk_id: every root-of-df-th posting of terms with 32 or more."""
    step = F.floor(F.sqrt("df")).cast("long")
    i = F.row_number().over(Window.partitionBy("term").orderBy("chunk_id")).cast("long") - 1
    ranked = postings.select("term", "chunk_id").join(term_stats.filter("df >= 32").select("term", "df"), "term").withColumn("i", i)
    return ranked.filter((F.col("i") >= step) & (F.col("i") % step == 0)).select("term", "i", "chunk_id")


def describe_term(index: Index, terms: DataFrame, limit: int = 8) -> DataFrame:
    """term, df, idf, postings, skips, champions of index terms (term): the first limit postings and skips by chunk id."""
    wanted = terms.select("term").distinct()
    sample = lambda rows, order, what, name: rows.join(wanted, "term", "left_semi").withColumn("o", F.row_number().over(Window.partitionBy("term").orderBy(order))).filter(F.col("o") <= limit).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", what.alias("x")))), lambda s: s["x"]).alias(name))
    held = index.postings.join(wanted, "term", "left_semi")
    facts = wanted.join(index.term_stats.select("term", "df", "idf"), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("idf", F.lit(0.0)).alias("idf"))
    out = facts.join(sample(held, "chunk_id", F.struct("chunk_id", "tf", "tf_title", F.slice("positions", 1, 8).alias("positions")), "postings"), "term", "left")
    out = out.join(sample(skip_plan(held, index.term_stats), "i", F.struct("i", "chunk_id"), "skips"), "term", "left")
    return out.join(sample(index.champions, "rnk", F.col("chunk_id"), "champions"), "term", "left")


def build_stats(index: Index) -> DataFrame:
    terms = index.term_stats.agg(F.count("*").alias("terms"))
    return index.chunks.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.round(F.avg("tokens"), 1).alias("avg_tokens")).crossJoin(F.broadcast(terms))
