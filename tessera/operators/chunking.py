"""Documents (doc_id, title, text, ...) to chunks, by one of four strategies. No shuffle: each document by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sentences, tokens
from tessera.plans.config import AnalyzerConfig, IndexConfig

# fixed values: abbreviations whose points end no sentence
ABBREVIATIONS = ("Corp.", "Inc.", "Ltd.", "U.S.", "U.K.", "e.g.", "i.e.", "vs.")
# fixed value: an amount with its unit, or cells between bars
TABLE_LINE = r"(?i)(\|.*\|)|(\$?\s*[0-9][0-9,.]*\s*(B|M|%|million|billion))"
_RAW = AnalyzerConfig(stemming=False, remove_stopwords=False)


def mark_of(i: int) -> str:
    """What stands for an abbreviation while sentences are cut: no text has it, and it ends in no point."""
    return f"\ue100{chr(0x61 + i)}\ue101"


def n_tokens(text: Column, finance: bool = False) -> Column:
    return F.size(tokens(text, AnalyzerConfig(stemming=False, remove_stopwords=False, finance_mode=finance)))


def is_table_line(line: Column) -> Column:
    return line.contains("|") | (line.rlike(TABLE_LINE) & line.contains("$"))


def finance_sentences(text: Column) -> Column:
    """Sentences line by line; table lines stay whole, and abbreviations end nothing."""
    def marked(t: Column) -> Column:
        for i, a in enumerate(ABBREVIATIONS):
            t = F.replace(t, F.lit(a), F.lit(mark_of(i)))
        return t

    def restored(t: Column) -> Column:
        for i, a in enumerate(ABBREVIATIONS):
            t = F.replace(t, F.lit(mark_of(i)), F.lit(a))
        return t

    lines = F.filter(F.transform(F.split(marked(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.flatten(F.transform(lines, lambda x: F.when(is_table_line(x), F.array(x)).otherwise(sentences(x)))), restored)


def _windows(df: DataFrame, config: IndexConfig) -> DataFrame:
    """Sliding windows over the column sents: idx, a, b (b exclusive)."""
    s = F.size("sents")
    last = F.greatest(F.lit(0), F.ceil((s - config.sentences) / config.step).cast("int")) * config.step
    spans = F.transform(F.sequence(F.lit(0), last, F.lit(config.step)), lambda a: F.struct(a.alias("a"), F.least(s, a + config.sentences).alias("b")))
    return df.select("*", F.posexplode(spans).alias("idx", "span")).select("*", "span.*").drop("span")


def fixed_spans(counts: list[int], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first sentence, end, tokens) of each chunk: sentences are added until size tokens are reached, and whole closing
    sentences worth overlap tokens carry over, unless that would be the whole chunk. What is left at the end, even a mere
    carry-over, is a chunk too."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(counts):
        total += n
        if total < size:
            continue
        out.append((begin, i + 1, total))
        carry, at = 0, i + 1
        while at > begin and carry < overlap:
            at -= 1
            carry += counts[at]
        begin, total = (i + 1, 0) if at == begin else (at, carry)
    if begin < len(counts):
        out.append((begin, len(counts), total))
    return out


def _fixed(df: DataFrame, config: IndexConfig) -> DataFrame:
    """Only the sentences' token counts go through Arrow: the rule carries state that no built-in expresses in linear time."""
    size, overlap = config.size, config.overlap

    @F.pandas_udf("array<struct<a:int,b:int,t:int>>")
    def spans(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: [{"a": a, "b": b, "t": t} for a, b, t in fixed_spans(c.tolist(), size, overlap)])

    found = df.withColumn("spans", spans(F.transform("sents", lambda s: n_tokens(s))))
    return found.select(*df.columns, F.posexplode("spans").alias("idx", "span")).select(*df.columns, "idx", "span.a", "span.b", F.col("span.t").alias("n"))


def doc_of(chunk_id: str = "chunk_id") -> Column:
    """The document of a chunk, by its id."""
    return F.regexp_replace(chunk_id, "#[0-9]+$", "")


def chunk(docs: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """chunk_id, doc_id, title, text, sentence_start, sentence_end, strategy, tokens, and docs' other columns."""
    other = [c for c in docs.columns if c not in ("doc_id", "title", "text")]
    finance = config.strategy == "finance"
    if config.strategy == "whole":
        cut = docs.withColumns({"idx": F.lit(0), "a": F.lit(0), "b": F.lit(0), "piece": F.col("text"), "n": n_tokens(F.col("text"))})
    else:
        found = finance_sentences(F.col("text")) if finance else sentences(F.col("text"))
        split = docs.withColumn("sents", found)
        piece = F.array_join(F.slice("sents", F.col("a") + 1, F.col("b") - F.col("a")), " ")
        names = [*docs.columns, "idx", "a", "b", "piece", "n"]
        if config.strategy == "fixed":
            full = _fixed(split.filter("size(sents) > 0"), config).withColumn("piece", piece)
            none = split.filter("size(sents) = 0").withColumns({"idx": F.lit(0), "a": F.lit(0), "b": F.lit(0), "piece": F.col("text"), "n": n_tokens(F.col("text"))})
            cut = full.select(*names).unionByName(none.select(*names))
        else:  # a text without sentences has one empty window, which stands for the whole
            none = F.size("sents") == 0
            full = _windows(split, config).withColumn("piece", F.when(none, F.col("text")).otherwise(piece))
            tokens_ = F.when(none, n_tokens(F.col("text"))).otherwise(n_tokens(F.col("piece"), True)) if finance else n_tokens(F.col("piece"))
            cut = full.withColumn("n", tokens_).select(*names)
    return cut.select(
        F.concat_ws("#", "doc_id", F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "title", F.col("piece").alias("text"),
        F.col("a").alias("sentence_start"), F.col("b").alias("sentence_end"), F.lit(config.strategy).alias("strategy"), F.col("n").alias("tokens"), *other,
    )
