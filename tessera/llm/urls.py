"""Operator 7: URL filters by a blocked Bloom filter and an exact hash join.

Two things speak on a page. Rules are a short sequence of host and path prefixes: a page's candidates (its host's suffixes by the
rules' path lengths) are looked up in a map that travels with the plan, so rules cost no shuffle. Listed pages are a table of
any size, as canonical URLs. The Bloom filter over them is a table of blocks of eight 64-bit words; an entry sets one bit in
each word of one block. A page that no rule speaks for looks up the block of its own canonical URL and passes only with all
eight bits set; what passes goes to a hash join with the list itself, which removes the false positives.

Everything is built-in expressions. The filter takes 16 bits an entry; it is broadcast up to BROADCAST entries and joined
by block beyond. Each distinct canonical URL is judged once, so a repeated page costs one judgement; pages without a host
never meet the list, and are dealt evenly.

Defined cases: a null URL, or one without ://, has an empty host and path and no rule, and is allowed; several pages of one URL
get the same verdict; the longest rule that fits wins, a block before an allow of equal length; with no rules and no list all are
allowed; URLs may be of any length; repeated rows are judged each; an empty table gives an empty table; other columns pass
through, but for those named like a result column (host, path, rule, verdict), which the result replaces.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, others, written

BITS_PER_ENTRY = 16
WORDS = 8
#: Entries up to which the filter (2 MB at this bound) is broadcast.
BROADCAST = 1_000_000
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def canonical(host: Column, path: Column) -> Column:
    """A page's key in a list: host without www. and port, path without its last slash."""
    return F.concat(F.lit("="), F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":\d+$", ""), F.regexp_replace(path, "/$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block and its eight words, from entries (key)."""
    marked = entries.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(candidates: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """The candidates (key) that the filter of the n entries passes: all that are listed, and few others."""
    blocks = max(1, n * BITS_PER_ENTRY // (64 * WORDS))
    table = bloom(entries, blocks)
    table = F.broadcast(table) if n <= BROADCAST else table
    all_set = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return candidates.withColumn("block", _block(F.col("key"), blocks)).join(table, "block").filter(all_set).drop("block", *[f"w{i}" for i in range(WORDS)])


def _rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, verdict, rule) of the rule that wins, null if none fits."""
    known = {}
    for verdict, rule in sorted(rules):  # of one rule with two verdicts the block stays
        known[rule] = max(known.get(rule, verdict), verdict)
    none = F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    if not known:
        return none
    verdicts = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    lengths = sorted({len(r) - r.index("/") for r in known})
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    fits = F.filter(keys, lambda k: F.map_contains_key(verdicts, k))
    return F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("size"), F.element_at(verdicts, k).alias("verdict"), k.alias("rule"))))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame | None = None) -> DataFrame:
    """pages (url, ...) with host, path, rule and verdict; rules: (verdict, "host/path"); listed: url of blocked pages."""
    own = others(pages, "host", "path", "rule", "verdict")
    best, key, hit = fresh(pages, "best", "key", "hit")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select(*own, host.alias("host"), path.alias("path"))
    parts = parts.select("*", _rule_of(F.col("host"), F.col("path"), rules).alias(best))
    result = [*own, "host", "path", F.col(best)["rule"].alias("rule")]
    if listed is None:
        return parts.select(*result, F.coalesce(F.col(best)["verdict"], F.lit("allow")).alias("verdict"))
    entries = written(listed.filter(host_of(F.col("url")) != "").select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).distinct(), "listed")
    n = entries.count()
    # what cannot be listed gets keys of its own: a canonical URL begins with another sign
    apart = F.concat(F.lit("#"), (F.monotonically_increasing_id() % 9973).cast("string"))
    parts = parts.withColumn(key, F.when((F.col("host") == "") | F.col(best).isNotNull(), apart).otherwise(canonical(F.col("host"), F.col("path"))))
    asked = parts.filter(~F.startswith(key, F.lit("#"))).select(F.col(key).alias("key")).distinct()
    hits = written(possible(asked, entries, n).join(entries, "key", "left_semi").select(F.col("key").alias(hit)), "hits")
    verdict = F.coalesce(F.col(best)["verdict"], F.when(F.col(hit).isNotNull(), F.lit("block")), F.lit("allow"))
    return parts.join(hits, F.col(key) == F.col(hit), "left").select(*result, verdict.alias("verdict"))


#: The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Its list, which stands for one from outside: the canonical URLs of all pages whose host has one of these labels.
LISTED_LABELS = ("ads-track", "casino-win", "cheap-pills", "free-bets")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    named = F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.lit(list(LISTED_LABELS)))
    return filter_urls(pages, RULES, pages.filter(named).select("url")).select("page_id", "host", "path", "rule", "verdict")
