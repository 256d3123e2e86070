"""Operator 3: SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Two fingerprints link when they differ
in at most MAX_BITS bits, and the components of those links are the groups of near-duplicates.

Equal fingerprints are one from the start, so copies cost nothing further. Fingerprints that could link are brought
together by exact keys: the 64 bits are cut into b bands, and of two fingerprints that differ in at most 4 bits at least
b - 4 bands are equal, so every choice of b - 4 bands is a key. (Pivot distances alone can't deal out the work: a
coordinate of a random 64-bit fingerprint stays within 4 for 57 % of pairs, so cells over them would repeat most rows.)
b follows the number of distinct fingerprints, so that a key is expected to hold under 16; any b is exact.

Within a key, the pivot table decides: each fingerprint's Hamming distances to PIVOTS reference fingerprints. By the
triangle inequality a pair whose table rows differ by more than 4 in any coordinate can't link; those are discarded
coordinate by coordinate, and only the survivors are compared. A task emits a spanning forest of its links, never all
pairs. Keys with over HOT fingerprints are dealt in chunks: every two chunks meet in a task of their own. Keys with over HUGE
are not paired: every fingerprint names the points within half of MAX_BITS of it in the bits that the key leaves free. Two that
link name a common point, and all that name one point link, so they become a star around the least: as many rows as the
fingerprints times a number that follows from the key.

Components come from alternating large-star and small-star rounds on the forest edges, each round written out.

Defined cases: null and blank texts have fingerprint zero and link like any other; texts of any length are read whole; rows
with a null id take part, and a component's id is its least non-null id; repeated rows get equal results; an empty table gives
an empty table; of the input only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_text, id_back, memory, row_keys, scratch, spread, written

MAX_BITS = 4
SEED = 42
PIVOTS = 24
HOT, HUGE = 256, 4096


def _pivots(n: int) -> np.ndarray:
    """Reference fingerprints: hashes of 0 to n - 1, fixed for all runs."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)], np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a whole text's shingles, repeats included; one of the whole if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, k1 and k2 (of the row) and fp (the fingerprint as a signed long) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for f in frames:
            found = np.array([fingerprint(x if isinstance(x, str) else None, shingle) for x in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "k1": f["k1"], "k2": f["k2"], "fp": found})

    k1, k2 = row_keys()
    rows = spread(docs.select("doc_id", "text")).select(id_as_text(), "text", k1.alias("k1"), k2.alias("k2"))
    return id_back(rows.mapInPandas(run, "doc_id string, k1 long, k2 long, fp long"), docs)


def masks(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """The key masks for n distinct fingerprints: the fewest whose keys are expected to hold under 16 each."""
    for bands in range(max_bits + 2, 64):
        edges = [round(64 * k / bands) for k in range(bands + 1)]
        keep = bands - max_bits
        if n / 2 ** math.floor(64 * keep / bands) < 16 or bands >= 12:
            parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(bands)]
            return [sum(c) for c in combinations(parts, keep)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def linked(fps: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs (a, b) of places in fps, those within max_bits: pivot rows first, then the bits."""
    for k in range(table.shape[1]):
        column = table[:, k]
        near = np.abs(column[a] - column[b]) <= max_bits
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    return a[near], b[near]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place reachable over links (a, b), for each of n places."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == old).all():
            return root


def _forest(fps: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], table: np.ndarray, max_bits: int) -> pd.DataFrame:
    a, b = linked(fps, *pairs, table, max_bits)
    root = roots(len(fps), a, b)
    far = root != np.arange(len(fps))
    out = pd.DataFrame({"u": fps[far].view(np.int64), "v": fps[root[far]].view(np.int64)})
    return out[out["u"] != out["v"]].drop_duplicates()


def _table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ _pivots(PIVOTS)[None, :]).astype(np.int16)


def _links(max_bits: int):
    """Rows of (fps) -> forest edges; groups of one size are paired together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for f in frames:
            by_size: dict[int, list[np.ndarray]] = {}
            for x in f["fps"]:
                by_size.setdefault(len(x), []).append(np.asarray(x, np.int64))
            for size, groups in by_size.items():
                i, j = np.triu_indices(size, 1)
                step = max(1, min(1_000_000 // max(1, len(i)), 50_000 // size))
                for k in range(0, len(groups) if len(i) else 0, step):
                    fps = np.concatenate(groups[k : k + step]).view(np.uint64)
                    base = np.arange(0, len(fps), size)[:, None]
                    yield _forest(fps, ((base + i).ravel(), (base + j).ravel()), _table(fps), max_bits)

    return run


def _points(chosen: list[int], max_bits: int):
    """Rows of (t, fp) -> fp and each point within half of max_bits of it in the bits that key t leaves free."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips: dict[int, np.ndarray] = {}
        for f in frames:
            for t, part in f.groupby("t"):
                if t not in flips:
                    free = [1 << b for b in range(64) if not chosen[t] >> b & 1]
                    flips[t] = np.array([sum(c) for k in range(max_bits // 2 + 1) for c in combinations(free, k)], np.uint64)
                fps = part["fp"].to_numpy(np.int64).view(np.uint64)
                step = max(1, 1_000_000 // len(flips[t]))
                for k in range(0, len(fps), step):
                    some = fps[k : k + step]
                    yield pd.DataFrame({"fp": np.repeat(some, len(flips[t])).view(np.int64), "point": (some[:, None] ^ flips[t][None, :]).ravel().view(np.int64)})

    return run


def _stars(met: DataFrame, chosen: list[int], max_bits: int) -> DataFrame:
    """u, v: each fingerprint of the rows (t, fp) and the least that shares a point with it."""
    near = written(met.select("t", "fp").mapInPandas(_points(chosen, max_bits), "fp long, point long"), "points")
    least = written(near.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v < most").select("point", "v"), "least")
    return near.join(least, "point").filter("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def links(distinct: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT, huge: int = HUGE) -> DataFrame:
    """u, v: edges between fingerprints (fp, each once) whose components are those of all links within max_bits."""
    if max_bits % 2:
        raise ValueError("points lie half of max_bits away, which must be even")
    chosen = masks(distinct.count(), max_bits)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(chosen)])).alias("k")).select("fp", "k.*")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, ["t", "key"]), "met")
    cold = met.filter(F.col("n") <= hot).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    chunks = F.ceil(F.col("n") / (hot // 2))
    chunk = F.pmod(F.xxhash64("fp", F.lit(3)), chunks).cast("int")
    warm = (
        met.filter((F.col("n") > hot) & (F.col("n") <= huge))
        .select("t", "key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)).alias("d"))
        .groupBy("t", "key", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )
    found = cold.unionByName(warm).mapInPandas(_links(max_bits), "u long, v long")
    crowd = met.filter(F.col("n") > huge)
    return found.unionByName(_stars(crowd, chosen, max_bits)) if crowd.limit(1).count() else found


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of the edges (u, v)."""

    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    def round_(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points from the larger node to a smaller one
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        return large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()

    e = written(edges.filter("u != v").distinct(), "edges")
    before = settled(e)
    while before[0]:
        e = written(round_(e), "edges")
        now = settled(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, k1 and k2 (of the row), fp, component_id and keeper (the keys of the row that stands for the component) of every row."""
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    with scratch(docs.sparkSession):
        found = written(fingerprints(docs, shingle), "fingerprints", keep=True)
        distinct = written(found.groupBy("fp").agg(F.min(rep).alias("rep")), "distinct")
        comp = written(components(links(distinct.select("fp"), max_bits, hot)), "components")
        grouped = comp.join(distinct, comp["node"] == distinct["fp"]).select("fp", "root", "rep")
        heads = grouped.groupBy("root").agg(F.min("rep").alias("head"))
        named = grouped.join(heads, "root").select(F.col("fp").alias("of"), "head")
        # written, so that both sides of the last join come straight from files and a hot fingerprint's rows can be split
        of = written(distinct.join(named, distinct["fp"] == named["of"], "left").select("fp", F.coalesce("head", "rep").alias("head")), "heads", keep=True)
    return found.join(of, "fp").select("doc_id", "k1", "k2", "fp", F.col("head.doc_id").alias("component_id"), F.struct("head.k1", "head.k2").alias("keeper"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
