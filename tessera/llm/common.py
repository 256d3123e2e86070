"""What several operators share: word rules, the shared work folder, and even input splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs between it.
SPACE = " \t\n\x0b\x0c\r"
#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name of the operator's own for each of names, none of which df has (whatever its case)."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(prefix + n.lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def others(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of df, quoted, but for those that a result column replaces (names differ by more than case)."""
    gone = {c.lower() for c in replaced}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_memories: dict[str, object] = {}


def memory(name: str = "", make: Callable[[], object] | None = None):
    """What a Python worker remembers between tasks, of one operator at a time: asking for another drops it."""
    for other in [k for k in _memories if k != name]:
        del _memories[other]
    if make and name not in _memories:
        _memories[name] = make()
    return _memories.get(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all run on this machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        return


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables written within it that are not to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def written(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage and survives lost executors. The table goes with its
    scratch scope (a kept one with the scope around it), or, where there is none, when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    # what the write shuffled is of no use once the table stands
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def id_as_text() -> Column:
    """doc_id as text, as which it goes through Python: whole numbers beside nulls would turn into floats there."""
    return F.col("doc_id").cast("string").alias("doc_id")


def id_back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with doc_id in the type it has in docs."""
    return df.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def row_keys() -> list[Column]:
    """Two longs that tell rows of one id and text from all others: a hash of the id, which for whole numbers is one to one, and
    one of both. Rows of different ids are never taken for each other by the second alone."""
    return [F.xxhash64(F.col("doc_id"), F.lit(1)), F.xxhash64("doc_id", "text")]


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, dealt anew only if its scan has fewer (one small file)."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc32_of(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
