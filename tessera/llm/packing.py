"""Operator 1: bulk-synchronous best-fit packing of tokenised documents into fixed-size sequences.

Documents (cut into pieces of at most one sequence) and gaps (the free ends of sequences) are range-sorted by size.
Each round deals the sizes out by range to tasks; every task sweeps its range from the largest size down, so that a
piece meets the smallest gap that holds it (its successor), and pieces that want the same gap are told apart by rank:
the lower ranks win, the others wait for the next round. Then the gaps shrink and the next round begins, over fewer and
wider ranges, down to one. What no gap can hold opens new sequences: as many as the waiting tokens fill.

Pieces of one length are alike, and so are gaps of one history, so both sides travel as runs (size, first rank, count):
a round handles as many rows as there are distinct sizes and histories. That number follows the sequence length, never
the corpus, so the rounds cost the same at any scale. The corpus itself is touched twice: to tokenise it, and to give
every piece its rank within its length and look up the run that places it. A length is ranked within as many salted groups as
its share of all pieces asks for, GROUPS for each shuffle partition in all, and the ranks are then shifted, so no group grows
with the corpus faster than the cluster. Runs are broadcast RUNS at a time.

Defined cases: a null text counts as empty and yields the closing id alone; ids may be null; repeated rows and equal ids are
packed row by row; a text of any length is tokenised whole and cut into pieces; an empty table gives an empty table; of the
input only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, id_as_text, id_back, memory, spread, written

#: For each shuffle partition pieces are ranked in so many groups; besides, every length has one at least.
GROUPS = 8
#: Runs that a range task of the first round sweeps; ranges are halved until one task sees all that is left.
SWEPT = 512
#: Runs that are sent to the workers at once (32 bytes each).
RUNS = 1_000_000
#: Encoded words kept by a worker before it forgets them.
CACHE = 800_000
#: Texts encoded together.
GROUP = 250
RUN = "kind string, size int, first long, count long"
MATCH = "kind string, size int, first long, count long, bin long, gap int"


class WordTokenizer:
    """Ids of a tokenizer that drops white space, encoded word by word with a bounded memory of words.

    Its normaliser and splitter never look across white space, so a text's ids are its words' ids in a row. New words of
    plain letters, with or without a closing point or comma, are encoded many to a call: they are split into one or two
    parts, and each part's last token carries the word-end mark, which tells where a word's ids end.

    Where the tokenizer lower-cases, texts within Latin-1 are lower-cased before, which there changes single letters alone,
    and a point or comma between a letter and white space becomes a word of its own, as the splitter would have it: fewer
    different words are left to encode and to remember.
    """

    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,]?)")
    BEYOND = re.compile("[^\x00-\xff]")
    CLOSING = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=[\x20\x09-\x0D]|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(mark) and token.endswith(mark)
        self.known: dict[str, bytes] = {}
        self.words = re.compile(WORD).findall
        self.folds = self.ends.any() and self._ids("ABC É") == self._ids("abc é") and self._ids("abc.") == self._ids("abc .")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, text: str | None) -> list[str]:
        if not isinstance(text, str):
            return []
        if self.folds and not self.BEYOND.search(text):
            text = self.CLOSING.sub(r" \1", text.lower())
        return self.words(text)

    def _learn(self, new: list[str]) -> None:
        plain, parts, rest = [], [], []
        for w in new:
            if self.ends.any() and (m := self.PLAIN.fullmatch(w)):
                plain.append(w)
                parts.append(2 if m[1] else 1)
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.asarray(e.ids, "<u4").tobytes()
        for k in range(0, len(plain), 2000):
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(plain[k : k + 2000])], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids])[np.cumsum(parts[k : k + 2000]) - 1] + 1) * 4
            data, at = ids.tobytes(), 0
            for w, stop in zip(plain[k : k + 2000], stops.tolist(), strict=True):
                self.known[w] = data[at:stop]
                at = stop

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; what is no string has none."""
        cut = [self._words(t) for t in texts]
        known = self.known
        new = set(chain.from_iterable(cut)).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(chain.from_iterable(cut))
        self._learn(list(new))
        return [b"".join([known[w] for w in words]) for words in cut]


def coder_of(path: str) -> WordTokenizer:
    """The worker's own tokenizer: its memory of words outlasts a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return memory(f"tokenizer {path}", lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with keep_ids its ids (little-endian u32); nth tells all pieces
    of one evaluation apart, so the pieces are to be written before they are packed."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"] + ["ids"] * keep_ids
    schema = "doc_id string, piece int, start long, length int, ids_crc32 long, nth long" + ", ids binary" * keep_ids

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(tokenizer)
        end = np.asarray([closing], "<u4").tobytes()
        nth = TaskContext.get().partitionId() << 40
        for frame in frames:
            out: list[tuple] = []
            for g in range(0, len(frame), GROUP):
                part = frame.iloc[g : g + GROUP]
                for doc_id, ids in zip(part["doc_id"], coder.encode(part["text"].tolist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        row = (doc_id, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), nth)
                        out.append((*row, piece) if keep_ids else row)
                        nth += 1
            yield pd.DataFrame(out, columns=names)

    return id_back(spread(docs.select(id_as_text(), "text")).mapInPandas(cut, schema), docs)


def sweep(runs: list[tuple]) -> list[tuple]:
    """One task's sweep over its range, from the largest size down; runs: (kind, size, first, count), kind d or g.

    Gaps go on a stack as the sweep passes them, so its top is the smallest gap that holds the piece at hand. A gap takes
    as many pieces of the run as fit it. Returns matches ("m", length, first rank, count, first bin, gap before) and the
    runs that are left, gaps with their new size.
    """
    stack: list[list[int]] = []
    out: list[tuple] = []
    shrunk: list[tuple] = []
    for kind, size, first, count in sorted(runs, key=lambda r: (-r[1], r[0] == "d", r[2])):
        if kind == "g":
            stack.append([size, first, count])
            continue
        while count and stack:
            gap, bin_, n = stack.pop()
            fit = gap // size
            full = min(n, count // fit)
            for k in range(fit if full else 0):
                out.append(("m", size, first + k * full, full, bin_, gap - k * size))
            first, count = first + full * fit, count - full * fit
            if full:
                shrunk.append(("g", gap - fit * size, bin_, full))
            if full < n and count:  # fewer than one gap's worth are left: they share the next gap
                for k in range(count):
                    out.append(("m", size, first + k, 1, bin_ + full, gap - k * size))
                shrunk.append(("g", gap - count * size, bin_ + full, 1))
                full, first, count = full + 1, first + count, 0
            if full < n:
                stack.append([gap, bin_ + full, n - full])
        if count:
            out.append(("d", size, first, count, 0, 0))
    return out + [(*x, 0, 0) for x in shrunk if x[1]] + [("g", *x, 0, 0) for x in stack]


def _swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = [r for f in frames for r in f.itertuples(index=False, name=None)]
    yield pd.DataFrame(sweep(runs), columns=["kind", "size", "first", "count", "bin", "gap"])


def on_cluster(spark: SparkSession, ranges: int) -> Callable[[list[tuple]], list[tuple]]:
    """A round as a Spark job: range-sorted runs, one sweep a range."""

    def go(runs: list[tuple]) -> list[tuple]:
        df = spark.createDataFrame(runs, RUN)
        df = df.repartitionByRange(ranges, "size") if ranges > 1 else df.coalesce(1)
        return [tuple(r) for r in df.mapInPandas(_swept, MATCH).collect()]

    return go


def plan(lengths: dict[int, int], capacity: int, round_: Callable[[int], Callable[[list[tuple]], list[tuple]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of every run of pieces; lengths: pieces of each length."""
    waiting = {n: (0, c) for n, c in lengths.items() if c}
    gaps: list[tuple[int, int, int]] = []
    bins, ranges, done = 0, 1 << (len(waiting) // SWEPT).bit_length(), []
    # pieces over half a sequence cannot share one: each opens its own
    for n in [n for n in waiting if 2 * n > capacity]:
        c = waiting.pop(n)[1]
        done.append((n, 0, c, bins, 0))
        if n < capacity:
            gaps.append((capacity - n, bins, c))
        bins += c
    while waiting:
        least = min(waiting)
        usable = [g for g in gaps if g[0] >= least]
        gaps = []  # a gap smaller than every waiting piece stays open
        out = round_(ranges)([("d", n, a, c) for n, (a, c) in waiting.items()] + [("g", *g) for g in usable]) if usable else [("d", n, a, c, 0, 0) for n, (a, c) in waiting.items()]
        matched = [x for x in out if x[0] == "m"]
        done += [(n, a, c, b, capacity - gap) for _, n, a, c, b, gap in matched]
        gaps = [(s, a, c) for kind, s, a, c, _, _ in out if kind == "g"]
        waiting = {n: (a, c) for kind, n, a, c, _, _ in out if kind == "d"}
        if ranges > 1 and usable:
            ranges //= 2
        elif waiting and not matched:
            need = -(-sum(n * c for n, (_, c) in waiting.items()) // capacity)
            gaps.append((capacity, bins, need))
            bins += need
    return done


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """found (pieces, already written once) with sequence_id and offset."""
    spark = found.sparkSession
    lengths = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    share = max(1, sum(lengths.values()) // (GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = np.array([-(-lengths.get(n, 0) // share) for n in range(capacity + 1)], np.int64)
    before = np.cumsum(salts) - salts  # of each length: the groups of shorter ones
    salt = F.pmod(F.xxhash64("nth"), F.element_at(F.lit(np.maximum(salts, 1).tolist()), F.col("length") + 1)).cast("int")
    salted = found.withColumn("salt", salt)
    shift = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("length", "salt").count().collect():  # at most GROUPS a partition, and one a length
        shift[before[r["length"]] + r["salt"]] = r["count"]
    for n in lengths:
        own = slice(before[n], before[n] + salts[n])
        shift[own] = np.cumsum(shift[own]) - shift[own]
    placed = np.array(sorted(plan(lengths, capacity, lambda k: on_cluster(spark, k))), np.int64).reshape(-1, 5) if lengths else np.zeros((0, 5), np.int64)

    def place_with(send):
        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before, shift, runs = send.value
            starts = (runs[:, 0] << 45) + runs[:, 1]
            for f in frames:
                n = f["length"].to_numpy(np.int64)
                rank = shift[before[n] + f["salt"].to_numpy(np.int64)] + f["rank"].to_numpy(np.int64) - 1
                run = runs[np.searchsorted(starts, (n << 45) + rank, side="right") - 1]
                yield f.drop(columns=["salt", "rank", "nth"]).assign(sequence_id=run[:, 3] + rank - run[:, 1], offset=run[:, 4])

        return place

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("nth")))
    ranked = ranked.withColumn("doc_id", id_as_text())
    types = ", ".join(f"{f.name} {'string' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in found.schema if f.name != "nth") + ", sequence_id long, offset long"
    out, at = None, 0
    while out is None or at < len(placed):
        # whole lengths at a time, so that each piece finds its run in one slice
        end = at if not len(placed) else int(np.searchsorted(placed[:, 0], placed[min(at + RUNS, len(placed)) - 1, 0], side="right"))
        low, high = (int(placed[at, 0]), int(placed[end - 1, 0])) if end > at else (0, capacity)
        send = spark.sparkContext.broadcast((before, shift, placed[at:end]))
        some = ranked.filter(F.col("length").between(low, high)) if end < len(placed) or at else ranked
        some = some.mapInPandas(place_with(send), types)
        out, at = some if out is None else out.unionByName(some), max(end, 1)
    return id_back(out, found)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, keep_ids: bool = True) -> DataFrame:
    """The packed pieces of docs (doc_id, text): where each piece lies, and with keep_ids its token ids."""
    return pack(written(pieces(docs, tokenizer, capacity, closing, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its whole ids, from pieces packed with keep_ids; a sequence has at most its capacity of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda t, p: F.concat(t, p["ids"])).alias("ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
