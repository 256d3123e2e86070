"""Operator 6: removal of long repeated word sequences, by super-k-mer partitioning.

A window is WINDOW consecutive words. Every run of SEED words has a hash, and a window's minimiser is the least of those
inside it (the leftmost among equals), so equal windows have equal minimisers at equal places. Consecutive windows that
share a minimiser form a super-k-mer, which travels as one packed string of its words.

1. Super-k-mers without their words (row, first window, windows, minimiser) are written, and minimisers counted. A window
   can repeat only where its minimiser occurs twice, so all others are settled here and no text of theirs ever moves.
2. The super-k-mers of repeated minimisers fetch their words and go, packed, to their minimiser's bucket. There the
   windows are sorted by content (hash first, then the words themselves) and counted exactly.
3. A minimiser with over HOT super-k-mers (a line that thousands of documents share) is no bucket of its own: equal
   super-k-mers are counted first, by a 128-bit digest, then the windows of the different ones, by theirs, with partial
   counts before each shuffle, so no task sees them all.
4. Repeated windows, as ranges, return to their rows, and every word they cover is removed.

Counts and ranges come from written tables, so a minimiser, a digest or a row that very many rows share is split by the joins
that meet it.

Rows are told apart by hashes of id and text, so rows repeated exactly share one set of windows and each gets its result.

Defined cases: a null text has no words and stays null; texts of fewer words than a window lose nothing; texts of any
length are read whole; rows with a null id take part; an empty table gives an empty table; other columns pass through as they
are, but for those named like a result column (n_words, n_removed, kept_sha256), which the result replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tessera.llm.common import WORD, fresh, memory, others, row_keys, scratch, spread, written

WINDOW = 35
SEED = 6
HOT = 500
#: Rows of buckets settled together.
BATCH = 20_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(WORD)


def hashed(words: list) -> np.ndarray:
    """64-bit hashes of words (strings or bytes)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive entries."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ hashes[k : len(hashes) - width + 1 + k]) * _MULT
            out ^= out >> np.uint64(31)
    return out


def super_kmers(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer of a text."""
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    seeds = rolled(hashes, seed)
    inside = window - seed + 1
    views = np.lib.stride_tricks.sliding_window_view(seeds, inside)
    at = np.empty(len(views), np.int64)
    for k in range(0, len(views), 1 << 16):
        at[k : k + (1 << 16)] = views[k : k + (1 << 16)].argmin(axis=1)
    at += np.arange(len(views))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(views)]), seeds[at[first]]


def repeated_windows(packed: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows) of every run of windows that occur more than once among the packed strings.

    Words become numbers one to one, so comparing numbers compares the words themselves; the rolled hash only sorts.
    """
    number: dict[str, int] = {}
    rows = [p.split(" ") for p in packed]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in r), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    keys = rolled(ids.astype(np.uint64) + np.uint64(1), window)
    inside = np.ones(len(ids), bool)  # windows that end in the row they begin in
    for k in range(1, window):
        inside[np.maximum(begins[1:], k) - k] = False
    at = np.flatnonzero(inside[: len(keys)])
    order = at[np.argsort(keys[at], kind="stable")]
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    flags = np.zeros(len(ids) + 1, np.int8)
    flags[a[equal]] = flags[b[equal]] = 1
    if not equal.all():  # different windows of one hash: count each content
        for h in np.unique(keys[a[~equal]]):
            seen: dict[bytes, list[int]] = {}
            for j in at[keys[at] == h].tolist():
                seen.setdefault(ids[j : j + window].tobytes(), []).append(j)
            for js in seen.values():
                flags[js] = len(js) > 1
    edge = np.diff(flags, prepend=np.int8(0))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(begins, first, side="right") - 1
    return row, first - begins[row], end - first


def _cut(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """k1, k2, first, windows, mini of every super-k-mer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for frame in frames:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "first", "windows", "mini")}
            for k1, k2, text in zip(frame["k1"].tolist(), frame["k2"].tolist(), frame["text"], strict=True):
                first, n, mini = super_kmers(hashed(_WORDS.findall(text)), window, seed)
                if len(first):
                    for name, x in zip(out, (np.full(len(first), k1, np.int64), np.full(len(first), k2, np.int64), first.astype(np.int32), n.astype(np.int32), mini.view(np.int64)), strict=True):
                        out[name].append(x)
            if out["k1"]:
                yield pd.DataFrame({name: np.concatenate(x) for name, x in out.items()})

    return docs.filter(F.col("text").isNotNull()).mapInPandas(run, "k1 long, k2 long, first int, windows int, mini long")


def _fetch(window: int):
    """Rows of (text, parts) -> the packed string of each part, and its digest where its minimiser is hot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        names = ["k1", "k2", "first", "mini", "packed", "digest"]
        for frame in frames:
            out: list[tuple] = []
            for k1, k2, text, *parts in zip(frame["k1"].tolist(), frame["k2"].tolist(), frame["text"], frame["first"], frame["windows"], frame["mini"], frame["hot"], strict=True):
                words = _WORDS.findall(text)
                for first, n, mini, hot in zip(*[p.tolist() for p in parts], strict=True):
                    packed = " ".join(words[first : first + n + window - 1])
                    out.append((k1, k2, first, mini, packed, xxhash.xxh3_128_digest(packed) if hot else None))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def _bucketed(window: int):
    """Rows sorted by minimiser -> the ranges of repeated windows, some thousands of rows of whole buckets at a time."""

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        row, first, n = repeated_windows(f["packed"].tolist(), window)
        return pd.DataFrame({"k1": f["k1"].to_numpy()[row], "k2": f["k2"].to_numpy()[row], "first": f["first"].to_numpy()[row] + first, "windows": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            minis = held["mini"].to_numpy()
            if len(held) < BATCH or minis[0] == minis[-1]:
                continue
            # the last minimiser's bucket may go on in the next batch
            cut = len(minis) - int(np.argmax(minis[::-1] != minis[-1]))
            yield settle(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield settle(held)

    return run


def _window_digests(window: int):
    """Rows of (digest, packed) -> the digest of each of its windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for f in frames:
            out = []
            for digest, packed in zip(f["digest"], f["packed"], strict=True):
                words = packed.split(" ")
                out += [(digest, k, xxhash.xxh3_128_digest(" ".join(words[k : k + window]))) for k in range(len(words) - window + 1)]
            yield pd.DataFrame(out, columns=["digest", "k", "w"])

    return run


def _hot_ranges(hot: DataFrame, window: int) -> DataFrame:
    """k1, k2, ranges (first, windows) of the repeated windows of hot minimisers.

    Equal super-k-mers count as one, with their number: of those that occur twice all windows repeat. The windows of the
    different ones are then counted by digest; every count is partial before its shuffle.
    """
    different = written(hot.groupBy("digest").agg(F.count("*").alias("n"), F.any_value("packed").alias("packed")), "different")
    windows = written(different.mapInPandas(_window_digests(window), "digest binary, k int, w binary"), "windows")
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    several = windows.join(twice, "w", "left_semi").groupBy("digest").agg(F.collect_set("k").alias("ks"))
    whole = F.sequence(F.lit(0), F.size(F.split("packed", " ")) - window)
    found = different.join(several, "digest", "left").select("digest", F.when(F.col("n") > 1, whole).otherwise(F.col("ks")).alias("ks")).filter("ks IS NOT NULL")
    # the run of a whole super-k-mer is one range, others go window by window
    ranges = F.when(F.size("ks") == F.array_max("ks") + 1, F.array(F.struct(F.lit(0).alias("k"), F.size("ks").alias("n")))).otherwise(F.transform("ks", lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))))
    met = hot.select("k1", "k2", "first", "digest").join(written(found.select("digest", ranges.alias("r")), "found"), "digest")
    return met.select("k1", "k2", F.transform("r", lambda r: F.struct((F.col("first") + r["k"]).alias("first"), r["n"].alias("windows"))).alias("ranges"))


def _without(text: str | None, firsts: np.ndarray | None, counts: np.ndarray | None, window: int) -> tuple[str | None, int, int, list[str]]:
    """A text without the words of its ranges of windows; its words, how many went, and those that are left."""
    if firsts is None or not len(firsts):
        words = _WORDS.findall(text) if text is not None else []
        return text, len(words), 0, words
    spans = [m.span() for m in _WORDS.finditer(text)]
    drop = np.zeros(len(spans) + 1, np.int32)
    np.add.at(drop, firsts, 1)
    np.add.at(drop, np.minimum(firsts + counts + window - 1, len(spans)), -1)
    gone = (np.cumsum(drop[:-1]) > 0).tolist()
    kept, parts, at = [], [], 0
    for (a, b), d in zip(spans, gone, strict=True):
        if not d:  # a removed word goes with the white space before it
            kept.append(text[a:b])
            parts.append(text[at:b])
        at = b
    return "".join(parts).strip(" \t\n\x0b\x0c\r"), len(spans), sum(gone), kept


def _removed(window: int, own: int, place: int, digest: bool, names: list[str]):
    """Rows of own columns (the text at place), firsts and counts -> the rows without their repeated words. Other columns stay in Arrow as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory()
        for batch in batches:
            out = [_without(t, None if f is None else np.asarray(f, np.int64), None if f is None else np.asarray(c, np.int64), window) for t, f, c in zip(*[batch.column(k).to_pylist() for k in (place, own, own + 1)], strict=True)]
            columns = batch.columns[:own]
            columns[place] = pa.array([o[0] for o in out], pa.string())
            columns += [pa.array([o[k] for o in out], pa.int64()) for k in (1, 2)]
            if digest:
                columns.append(pa.array([hashlib.sha256(" ".join(o[3]).encode("utf-8", "surrogatepass")).hexdigest() for o in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """k1, k2, ranges (first, windows): the runs of windows whose words also start anywhere else. docs has k1, k2 and text."""
    kmers = written(_cut(spread(docs), window, seed), "superkmers")
    counts = written(kmers.groupBy("mini").agg(F.count("*").alias("n")).filter("n > 1"), "minimisers")
    parts = kmers.join(counts, "mini").select("k1", "k2", F.struct("first", "windows", "mini", (F.col("n") > hot).alias("hot")).alias("part"))
    by_row = parts.groupBy("k1", "k2").agg(F.collect_set("part").alias("parts"))
    # arrays of numbers cross to Python as they are; arrays of structs would become an object each
    arrays = [F.col(f"parts.{c}").alias(c) for c in ("first", "windows", "mini", "hot")]
    sent = written(docs.join(by_row, ["k1", "k2"]).select("k1", "k2", "text", *arrays).mapInPandas(_fetch(window), "k1 long, k2 long, first int, mini long, packed string, digest binary"), "packed")
    cold = sent.filter(F.col("digest").isNull()).select("mini", "k1", "k2", "first", "packed")
    cold = cold.repartition("mini").sortWithinPartitions("mini").mapInPandas(_bucketed(window), "k1 long, k2 long, first int, windows int")
    one = cold.select("k1", "k2", F.array(F.struct("first", "windows")).alias("ranges"))
    return one.unionByName(_hot_ranges(sent.filter(F.col("digest").isNotNull()), window))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, digest: bool = False) -> DataFrame:
    """docs with repeated words cut from text, and n_words, n_removed (and kept_sha256 of the kept words)."""
    new = [("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())][: 2 + digest]
    own = others(docs, *[name for name, _ in new])
    a, b, c, d, r = fresh(docs, "k1", "k2", "r1", "r2", "ranges")
    keyed = docs.select("*", *[k.alias(x) for k, x in zip(row_keys(), (a, b), strict=True)])
    flat = F.array_distinct(F.flatten(F.collect_set("ranges")))
    with scratch(docs.sparkSession):
        found = repeated_ranges(keyed.select(F.col(a).alias("k1"), F.col(b).alias("k2"), "text"), window, seed, hot)
        ranges = written(found.groupBy(F.col("k1").alias(c), F.col("k2").alias(d)).agg(flat.alias(r)), "ranges", keep=True)
    schema = StructType([*docs.select(*own).schema])
    place = [f.name.lower() for f in schema].index("text")
    for name, kind in new:
        schema = schema.add(name, kind)
    split = [F.col(f"{r}.first"), F.col(f"{r}.windows")]
    met = keyed.join(ranges, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left").select(*own, *split)
    return met.mapInArrow(_removed(window, len(own), place, digest, schema.names), schema)


def op6_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
