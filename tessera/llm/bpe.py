"""Operator 8: byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

A text is cut by the vocabulary's pattern; each distinct piece is encoded once per worker and remembered (up to a bound).
Pieces new to a batch are laid out by length in padded matrices, one row a piece. Every round finds each row's
minimum-rank pair, leftmost first, by looking up all neighbouring pairs in an open-addressing hash table, merges it, and
compacts the rows; rows without a mergeable pair leave. Pieces over LONG bytes go through the same merges with a heap,
as a row of a matrix would cost the square of its length.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole; repeated rows are
encoded each; ids may be null; an empty table gives an empty table; of the input only doc_id and text are read, so other columns
cannot clash. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import id_as_text, id_back, memory, spread

LONG = 256
CACHE = 700_000
NONE = np.int64(2**62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressing table of a power-of-two size."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        size = 1 << max(4, int(len(pairs) * 4 - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ids = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        ids, at = np.array(list(pairs.values()), np.int64), self._slot(keys)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.ids[at[won]] = ids[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * _MIX
        return ((h ^ (h >> np.uint64(29))) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has none."""
        keys = (left << 32) | right
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ids[at], NONE)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at.flat[open_] = (at.flat[open_] + 1) & int(self.mask)
            got = self.keys[at.flat[open_]]
            hit = got == keys.flat[open_]
            out.flat[open_[hit]] = self.ids[at.flat[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for a rank file; the lowest rank merges first, leftmost among equals."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for whole, rank in self.ranks.items():
            for k in range(1, len(whole)):
                a, b = self.ranks.get(whole[:k]), self.ranks.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _matrix(self, rows: list[bytes], width: int) -> list[list[int]]:
        """Ids of rows of at most width bytes."""
        ids = np.full((len(rows), width + 1), -1, np.int64)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = self.single[np.frombuffer(r, np.uint8)]
        out: list[list[int]] = [[]] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            left, right = ids[:, :-1], ids[:, 1:]
            ranks = np.full(left.shape, NONE, np.int64)
            there = right >= 0
            ranks[there] = self.table.find(left[there], right[there])
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(alive)), at]
            ended = best == NONE
            for i in np.flatnonzero(ended):
                row = ids[i]
                out[alive[i]] = row[row >= 0].tolist()
            ids, at, best, alive = ids[~ended], at[~ended], best[~ended], alive[~ended]
            if not len(alive):
                break
            ids[np.arange(len(alive)), at] = best
            # close the hole right of each merged pair
            cols = np.arange(ids.shape[1] - 1)
            ids = np.where(cols[None, :] <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int64)], axis=1)
            used = int((ids >= 0).sum(axis=1).max())
            ids = ids[:, : used + 1]
        return out

    def _long(self, row: bytes) -> list[int]:
        """The same merges for one long row, with a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        rows = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[list[int]] = [[]] * len(rows)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if (whole := self.ranks.get(r)) is not None:
                out[i] = [whole]
            elif len(r) > LONG:
                out[i] = self._long(r)
            else:
                buckets.setdefault(max(4, (len(r) - 1).bit_length() and 1 << (len(r) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            for k in range(0, len(members), 1 << 20 >> width.bit_length()):
                some = members[k : k + (1 << 20 >> width.bit_length())]
                for i, ids in zip(some, self._matrix([rows[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes and remembers the pieces that are not known yet."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            self.known[p] = (",".join(map(str, ids)), len(ids), self.decode(ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.cut(text)
        self.learn(set(pieces))
        return [int(x) for p in pieces for x in self.known[p][0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def coder_of(path: str, pattern: str) -> ByteBPE:
    """The worker's own coder: its memory of pieces outlasts a task."""
    return memory(f"bpe {path} {pattern}", lambda: ByteBPE(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded text."""
    kept = ", ids array<int>, decoded binary" * keep_ids
    schema = f"doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(path, pattern)
        for frame in frames:
            for k in range(0, len(frame), 500):  # a bounded share of the batch at a time
                part = frame.iloc[k : k + 500]
                cut = [coder.cut(x) if isinstance(x, str) else [] for x in part["text"]]
                coder.learn({p for x in cut for p in x})
                out = []
                for pieces in cut:
                    found = [coder.known[p] for p in pieces]
                    ids, decoded = ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
                    row = (sum([x[1] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    out.append((*row, [int(x) for x in ids.split(",") if x], decoded) if keep_ids else row)
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return id_back(spread(docs.select(id_as_text(), "text")).mapInPandas(run, schema), docs)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids (doc_id, ids)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(path, pattern)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "decoded": [coder.decode([] if x is None else list(x)) for x in f["ids"]]})

    return id_back(encoded.select(id_as_text(), "ids").mapInPandas(run, "doc_id string, decoded binary"), encoded)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
