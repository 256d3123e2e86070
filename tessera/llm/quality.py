"""Operator 10: line-first quality rules, in built-in expressions only.

Each line is judged by itself: lines of navigation, boilerplate or symbols, and short lines without a sentence mark,
are removed. A document that loses too large a share of its characters this way is rejected, as is one that fails the
base rules (too few words, or mostly repeated three-word windows).

Defined cases: a null text counts as empty; an empty text has no words and fails the base rules; texts and lines of any
length are judged whole (the menu pattern repeats possessively, so its matching needs no stack however long the line);
repeated rows are judged each by itself; an empty table gives an empty table; every input column is kept, but for those
named like a result column, which the result replaces. Nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, fresh, let, others, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, whatever its language.
BOILERPLATE = (
    r"all rights reserved|licen[sc]ed under|terms of (?:use|service)|privacy policy|cookie policy|use[sd]? cookies"
    r"|enable javascript|copyright \(c\)|powered by wordpress|lorem ipsum|click here to|sign up for our newsletter"
    r"|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados"
)
#: Words that make up menu lines; of two that begin alike the longer comes first, as a match is never taken back.
NAVIGATION = (
    r"home|menu|login|log in|log out|sign in|sign up|register|search|next|previous|prev|back|top|share|print|contact us"
    r"|contact|about us|about|sitemap|help|faq|subscribe|read more|more|skip to content|archive|categories|tags"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; the defaults are those of the registered query."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    #: Of a line's characters: menu separators.
    max_separators_percent: int = 2
    #: Shorter lines need a sentence mark.
    min_chars_unmarked: int = 50
    #: Longer lines are prose, whatever phrases they hold.
    max_chars_boilerplate: int = 300
    max_lost_percent: int = 50


def _repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more."""
    last = F.size(words) - 3
    starts = F.sequence(F.lit(0), last)

    def at(i):
        return [words[i + k] for k in range(3)]

    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    ranked = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), F.concat_ws(" ", *at(i)).alias("w"), i.alias("i"))))
    empty = F.array().cast("array<int>")

    def beside(r):
        """Each entry of the sorted windows beside its neighbour: equal neighbours are repeats."""
        return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)).otherwise(empty))

    covered = let(ranked, lambda r: F.size(F.array_distinct(F.flatten(beside(r)))))
    # many texts repeat nothing: equal counts of windows and of distinct hashes prove it without the sort
    return F.when(last < 1, F.lit(0)).when(F.size(F.array_distinct(hashes)) == last + 1, F.lit(0)).otherwise(covered).cast("long")


def _count(text: Column, characters: str) -> Column:
    """How many of the characters text has; most texts have none, which a scan tells faster."""
    return F.when(text.rlike(f"[{characters}]"), F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(F.lit(0))


def _line_fails(line: Column, rules: QualityRules) -> Column:
    def judge(x):
        boilerplate = (F.length(x) <= rules.max_chars_boilerplate) & x.rlike(f"(?iu){BOILERPLATE}")
        navigation = (_count(x, "|»›•·") * 100 > F.length(x) * rules.max_separators_percent) | x.rlike(f"(?i)^(?:(?:{NAVIGATION})(?:[\\s|/>»›•·-]++|$))++$")
        unmarked = (F.length(x) < rules.min_chars_unmarked) & ~x.rlike(r"[.!?…。！？؟।:;]")
        noisy = _count(x, SYMBOLS) * 100 > F.length(x) * rules.max_symbol_percent
        return boilerplate | navigation | unmarked | noisy

    return let(F.btrim(line, F.lit(SPACE)), judge)


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with the base counts, base_failed, kept, the cleaned text (clean_text), and what the line rules removed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "lost_percent", "base_failed", "kept", "clean_text"]
    own = others(docs, *added)
    words, full, good = fresh(docs, "words", "full", "good")
    counted = docs.select(
        *own,
        words_of(F.col("text")).alias(words),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias(full),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    judged = counted.select(
        *own, "n_symbols", full,
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(words).cast("long").alias("n_words"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(words)).alias("n_repeat_words"),
        F.filter(full, lambda x: ~_line_fails(x, rules)).alias(good),
    )
    clean = F.array_join(good, "\n")
    left = F.length(F.translate(clean, SPACE, ""))
    whole = F.size(full) == F.size(good)
    lost = F.when(whole, F.lit(0.0)).otherwise((F.col("word_chars") - left) * 100.0 / F.col("word_chars"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    return judged.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.size(full).cast("long").alias("n_lines"),
        (F.size(full) - F.size(good)).cast("long").alias("n_lines_removed"),
        lost.alias("lost_percent"),
        failed.alias("base_failed"),
        clean.alias("clean_text"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_percent") <= rules.max_lost_percent))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed")
