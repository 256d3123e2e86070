"""Boolean, phrase, zone and metadata queries.

A query becomes a postfix list of leaves and operators. Every leaf becomes rows (leaf, chunk_id); one aggregate gathers the
leaves each chunk fulfils, and the postfix list becomes one predicate over that set: a single shuffle, whatever the depth. The
words of all leaves are analysed on the driver, and looked up in one go.

The grammar is tolerant: juxtaposed terms mean AND, a missing parenthesis is forgiven, an operator where an operand should be
is a word, and what cannot be reached by the grammar (as in `a NOT b`) is ignored. A term of nothing but stopwords holds
everywhere, a phrase of them nowhere. A phrase of which one term alone is known holds wherever that term does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import analyze_text
from tessera.operators.index import TITLE_GAP, Index

ZONES = ("title", "body", "text")
META = ("ticker", "filing", "filing_type", "period", "company", "lang", "source")
#: How tightly the operators bind.
BINDS = {"OR": 1, "AND": 2, "NOT": 3}
_PARTS = re.compile(r'"(?P<quoted>[^"]*)"|(?P<mark>[()])|(?P<word>[^\s()]+)')


@dataclass(frozen=True)
class Leaf:
    """A term, a phrase (exact), or a value of a metadata field; nowhere: the operand that is missing at a query's end."""

    text: str
    field: str = ""
    exact: bool = False
    nowhere: bool = False

    def __str__(self) -> str:
        return (f"{self.field}:" if self.field else "") + (f'"{self.text}"' if self.exact else self.text)


def _leaf_of(word: str) -> Leaf:
    """A word with or without a field before a colon, and with or without quotes around its value."""
    name, colon, value = word.partition(":")
    field = name.lower() if colon and name.lower() in ZONES + META else ""
    value = value if field else word
    exact = bool(field) and len(value) > 1 and value[0] == '"' == value[-1]
    return Leaf(value[1:-1] if exact else value, field, exact and field not in META)


def postfix(query: str) -> list[Leaf | str]:
    """Leaves and operators, each operator after its operands."""
    out: list[Leaf | str] = []
    waiting: list[str] = []
    wanted = True  # an operand comes next

    def settle(least: int) -> None:
        while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= least:
            out.append(waiting.pop())

    for m in _PARTS.finditer(query):
        part = m[0] if m.lastgroup != "quoted" else None
        if not wanted and part in ("AND", "OR"):
            settle(BINDS[part])
            waiting.append(part)
            wanted = True
        elif not wanted and part == ")" and "(" in waiting:
            settle(0)
            waiting.pop()
        elif not wanted and part in (")", "NOT"):
            break
        else:
            if not wanted:
                settle(BINDS["AND"])
                waiting.append("AND")
            wanted = part in ("(", "NOT")
            if wanted:
                waiting.append(part)
            else:
                out.append(Leaf(m["quoted"], exact=True) if part is None else _leaf_of(part))
    if wanted:
        out.append(Leaf("", nowhere=True))
    return out + [x for x in reversed(waiting) if x != "("]


def _zoned(df: DataFrame, zone: str) -> DataFrame:
    return df.filter("tf_title > 0") if zone == "title" else df.filter("tf_title < tf") if zone == "body" else df


def _facts(index: Index, terms: set[str]) -> dict[str, dict]:
    """Of each term that is indexed: in how many chunks it is, by zone."""
    if not terms:
        return {}
    rows = index.postings.filter(F.col("term").isin(sorted(terms))).groupBy("term").agg(F.count("*").alias("text"), F.count_if(F.col("tf_title") > 0).alias("title"), F.count_if(F.col("tf_title") < F.col("tf")).alias("body"))
    return {r["term"]: r.asDict() for r in rows.collect()}  # the words of one query


def _earlier(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def phrase(index: Index, terms: list[str], zone: str = "", facts: dict[str, dict] | None = None) -> DataFrame:
    """chunk_id of the chunks that hold the terms side by side."""
    facts = _facts(index, set(terms)) if facts is None else facts
    known = [t for t in terms if facts.get(t, {}).get(zone or "text")]
    nothing = index.postings.select("chunk_id").limit(0)
    if len(known) == 1:
        return _zoned(index.postings.filter(F.col("term") == known[0]), zone).select("chunk_id")
    if len(known) < len(terms) or not terms:
        return nothing
    different = list(dict.fromkeys(terms))
    everywhere = index.postings.filter(F.col("term").isin(different))
    held = everywhere.groupBy("chunk_id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(different)]).dropna()
    # where the phrase would begin, by each of its terms
    begins = [_earlier(F.col(f"p{different.index(t)}"), i) for i, t in enumerate(terms)]
    inside = {"title": lambda p: p < TITLE_GAP, "body": lambda p: p >= TITLE_GAP}.get(zone, lambda p: p >= 0)
    return held.filter(F.exists(reduce(F.array_intersect, begins), inside)).select("chunk_id")


class Plan:
    """A query's leaves and operators over an index."""

    def __init__(self, index: Index, query: str):
        self.index, self.parts = index, postfix(query)
        self.terms = {x: analyze_text(x.text, index.config.analyzer) for x in self.parts if isinstance(x, Leaf) and x.field not in META}
        self.facts = _facts(index, {t for ts in self.terms.values() for t in ts})

    def rows(self, leaf: Leaf) -> DataFrame | None:
        """The chunks of a leaf; None where it holds everywhere."""
        index = self.index
        if leaf.field in META:
            name = "filing_type" if leaf.field == "filing" else leaf.field
            if name not in index.chunks.columns:
                return index.postings.select("chunk_id").limit(0)
            value = leaf.text.strip().strip('"').casefold()
            wanted = [value, value.lstrip("$")] if name == "ticker" else [value]
            return index.chunks.filter(F.lower(name).isin(wanted)).join(index.chunk_stats, "chunk_id", "left_semi").select("chunk_id")
        terms = self.terms[leaf]
        if leaf.exact:
            return phrase(index, terms, leaf.field, self.facts) if terms else index.postings.select("chunk_id").limit(0)
        return _zoned(index.postings.filter(F.col("term") == terms[0]), leaf.field).select("chunk_id") if terms else None

    def size(self, leaf: Leaf | None) -> int:
        """What a part is expected to hold: the documents of a leaf's terms, or all chunks."""
        plain = leaf is not None and not leaf.field and not leaf.nowhere
        return sum(self.facts.get(t, {}).get("text", 0) for t in self.terms[leaf]) if plain else self.index.n

    def held(self) -> tuple[DataFrame, list[tuple[str, Column, list[str]]]]:
        """All chunks with the leaves that each fulfils; and every part in turn: (name, predicate, for AND its operands by size)."""
        found: dict[Leaf, Column] = {}
        tables: list[DataFrame] = []
        for x in self.parts:
            if isinstance(x, Leaf) and x not in found:
                rows = None if x.nowhere else self.rows(x)
                if rows is None:
                    found[x] = F.lit(not x.nowhere)
                else:
                    found[x] = F.array_contains("leaves", len(tables))
                    tables.append(rows.select("chunk_id", F.lit(len(tables)).alias("leaf")))
        universe, none = self.index.chunk_stats.select("chunk_id"), F.array().cast("array<int>")
        if tables:
            by_chunk = reduce(DataFrame.unionByName, tables).groupBy("chunk_id").agg(F.collect_set("leaf").alias("leaves"))
            universe = universe.join(by_chunk, "chunk_id", "left").select("chunk_id", F.coalesce("leaves", none).alias("leaves"))
        else:
            universe = universe.withColumn("leaves", none)
        steps, stack = [], []
        for x in self.parts:
            if isinstance(x, Leaf):
                stack.append((found[x], self.size(x), str(x)))
                steps.append((str(x), found[x], []))
                continue
            right = stack.pop()
            left = stack.pop() if x != "NOT" else right
            p = ~right[0] if x == "NOT" else left[0] & right[0] if x == "AND" else left[0] | right[0]
            stack.append((p, self.index.n, x))
            steps.append((x, p, [name for _, _, name in sorted((left, right), key=lambda s: s[1])] if x == "AND" else []))
        return universe, steps


def boolean(index: Index, query: str) -> DataFrame:
    """chunk_id of the chunks that a query holds for."""
    universe, steps = Plan(index, query).held()
    return universe.filter(steps[-1][1]).select("chunk_id")


def trace(index: Index, query: str) -> DataFrame:
    """step, node, n: how many chunks every leaf and operator of a query holds for, operands first; before an AND, a step with the
    order in which its operands are taken, the rarer first, and their number. The last step is the query. One job counts all."""
    universe, steps = Plan(index, query).held()
    counts = universe.agg(*[F.count_if(p).alias(f"n{i}") for i, (_, p, _) in enumerate(steps)])
    rows = []
    for i, (name, _, order) in enumerate(steps):
        if order:
            rows.append((f"order {' -> '.join(order)}", F.lit(len(order)).cast("long")))
        rows.append((name, F.col(f"n{i}")))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("node"), n.alias("n")) for k, (name, n) in enumerate(rows)])).alias("r")).select("r.*")
