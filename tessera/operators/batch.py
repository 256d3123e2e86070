"""Batches of queries answered from the documents themselves, several indexes and searches in one pass.

A posting is made where it is scored and goes at once: a task cuts its documents, scores every chunk against every query of the
batch and returns the chunks that can still be among a query's best, so what is shuffled follows the batch and not the corpus.
Results are those of the tables of index.py; every chunk and every term counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import _TABLE, ACCENTED, BLANKS, SEVERAL, _dropped, stems_of
from tessera.operators.chunking import doc_of, fixed_spans
from tessera.operators.index import TITLE_GAP
from tessera.plans.config import AnalyzerConfig, IndexConfig, SearchConfig
from tessera.plans.storage import written

#: Characters that are cut and scored together.
TEXT = 1_000_000
#: Scores that are held at a time.
CELLS = 1_000_000
#: Words or terms that a worker remembers, and rows it holds before it prunes them.
WORDS, HELD = 500_000, 300_000
_BREAK = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9(])")
#: A word of folded text, or the mark after a piece.
_WORD = re.compile(r"[\w" + re.escape(ACCENTED) + r"]+|\0")
_FOLD = _TABLE | {ord(a): b for a, b in SEVERAL}


def serves(config: IndexConfig) -> bool:
    return config.strategy in ("sentence", "whole", "fixed") and not config.analyzer.finance_mode


def sentences_of(text: str) -> list[str]:
    """What text.sentences gives for one text."""
    return [s for s in (p.strip(BLANKS) for p in _BREAK.split(text.strip(BLANKS))) if s]


class _Ids(dict):
    """Numbers of the words of a part."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


_folded: dict[str, str] = {}


def _fold(word: str) -> str:
    if word not in _folded:
        if len(_folded) > WORDS:
            _folded.clear()
        _folded[word] = word.translate(_FOLD)
    return _folded[word]


def cut(docs: list[tuple[str, str, str]], stemmed: bool) -> dict:
    """Documents (id, title, text) as numbered words: docs, sents (how many sentences each has), words, their stems, and ids, the
    words of each title and sentence in order with 0 after each."""
    sents, pieces = [], []
    for _, title, text in docs:
        own = sentences_of(text)
        sents.append(len(own))
        pieces.append(title or "")
        pieces += own
    joined = "\0".join([p.replace("\0", " ") if "\0" in p else p for p in pieces] + [""])
    known = _Ids({"\0": 0})
    found = _WORD.findall(joined.lower())
    ids = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
    words = [_fold(w) for w in known]
    stems = stems_of(False)
    return {"docs": [d[0] for d in docs], "sents": np.array(sents, np.int32).tobytes(), "words": words, "stems": ["", *(stems[w] if w else "" for w in words[1:])] if stemmed else [], "ids": ids.tobytes()}


class Part:
    """What cut has made, for some analyzers: pieces (a title, then its sentences) of numbered terms."""

    def __init__(self, made: dict, analyzers: list[AnalyzerConfig]):
        self.docs, self.sents = made["docs"], np.frombuffer(made["sents"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.sents + 1) - self.sents - 1
        self.ids = np.frombuffer(made["ids"], np.int32)
        self.ends = np.flatnonzero(self.ids == 0)
        real = np.array([i > 0 and w != "" for i, w in enumerate(made["words"])])
        self.counts = np.diff(np.cumsum(real[self.ids])[self.ends], prepend=0)
        self.names, self.of = [], []  # by analyzer its terms, and the term of each word, below zero where it is dropped
        for a in analyzers:
            known, dropped = _Ids(), {"", *_dropped(a)}
            of = [-1 if w in dropped else known[t] for w, t in zip(made["words"][1:], (made["stems"] if a.stemming else made["words"])[1:], strict=True)]
            self.names.append(list(known))
            self.of.append(np.array([-1, *of]))
        self.cut: dict[int, tuple] = {}

    def terms(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms in order, and where those of each piece begin."""
        if a not in self.cut:
            t = self.of[a][self.ids]
            keep = t >= 0
            self.cut[a] = t[keep], np.concatenate([[0], np.cumsum(keep)[self.ends]])
        return self.cut[a]

    def windows(self, strategy: str, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, number, first and last sentence (exclusive) of each chunk."""
        n = len(self.docs)
        if strategy == "whole":
            return np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), self.sents
        if strategy == "sentence":
            of, step = size
            each = np.maximum(0, -((of - self.sents) // step)) + 1
            d = np.repeat(np.arange(n), each)
            idx = np.arange(len(d)) - np.repeat(np.cumsum(each) - each, each)
            return d, idx, idx * step, np.minimum(self.sents[d], idx * step + of)
        rows = [(d, i, a, b) for d in range(n) for i, (a, b, _) in enumerate(fixed_spans(self.counts[self.first[d] + 1 : self.first[d] + 1 + self.sents[d]].tolist(), *size) or [(0, 0, 0)])]
        return tuple(np.array(rows, np.int64).reshape(-1, 4).T)

    def lengths(self, a: int, windows: tuple) -> np.ndarray:
        at, title, (_, _, begin, end) = self.terms(a)[1], self.first[windows[0]], windows
        return at[title + 1 + end] - at[title + 1 + begin] + at[title + 1] - at[title]

    def keep(self, a: int, wanted: np.ndarray) -> None:
        """Leaves out terms; good for counting chunks that hold a term, not for places."""
        t = self.of[a][self.ids]
        keep = (t >= 0) & np.append(wanted, False)[t]
        self.cut[a] = t[keep], np.concatenate([[0], np.cumsum(keep)[self.ends]])

    def postings(self, a: int, windows: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, term, tf and tf_title of each posting in the order of chunks; the length of each chunk."""
        terms, at = self.terms(a)
        d, _, begin, end = windows
        title = self.first[d]

        def gathered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = hi - lo
            before = np.cumsum(n) - n
            place = np.arange(int(n.sum()))
            return np.repeat(np.arange(len(n)), n), terms[place + np.repeat(lo - before, n)], place - np.repeat(before, n)

        chunks, own, _ = gathered(at[title + 1 + begin], at[title + 1 + end])
        t_chunks, t_own, t_place = gathered(at[title], at[title + 1])
        v = max(1, len(self.names[a]))
        key = np.sort(np.concatenate([(chunks * v + own) * 2, (t_chunks * v + t_own) * 2 + (t_place < TITLE_GAP)]))
        both = key >> 1
        starts = np.flatnonzero(np.diff(both, prepend=-1))
        tf = np.diff(starts, append=len(key))
        tf_title = np.add.reduceat(key & 1, starts) if len(starts) else starts
        c = both[starts] // v
        return c, both[starts] - c * v, tf, tf_title, self.lengths(a, windows)


def pieces(batches: Iterator[pa.RecordBatch], stemmed: bool) -> Iterator[dict]:
    """What a task reads, cut in parts of about TEXT characters."""
    own, n = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "title", "text")], strict=True):
            own.append(row)
            n += len(row[2])
            if n >= TEXT:
                yield cut(own, stemmed)
                own, n = [], 0
    if own:
        yield cut(own, stemmed)


def _cut_of(config: IndexConfig) -> tuple[str, tuple[int, int]]:
    return config.strategy, {"sentence": (config.sentences, config.step), "fixed": (config.size, config.overlap)}.get(config.strategy, (0, 0))


def unique(docs: DataFrame) -> DataFrame:
    """docs, one row for each doc_id, written."""
    return written(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"]), "docs")


CUT = pa.schema([("k", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("docs", pa.list_(pa.string())), ("sents", pa.binary()), ("words", pa.list_(pa.string())), ("stems", pa.list_(pa.string())), ("ids", pa.binary())])
PARTS = ["docs", "sents", "words", "stems", "ids"]


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in schema}, schema)


def stats(docs: DataFrame, configs: list[IndexConfig], wanted: dict[AnalyzerConfig, list[str]] | None = None) -> tuple[DataFrame, list[tuple[int, int, DataFrame]]]:
    """docs as parts (written), and of each index of them the chunks with terms, their total length and the statistics of terms (of
    those wanted by its analyzer, where given)."""
    kinds = list(dict.fromkeys((_cut_of(c), c.analyzer) for c in configs))
    analyzers = list(dict.fromkeys(a for _, a in kinds))
    only = [set(wanted[a]) for a in analyzers] if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = [{} for _ in kinds], [0] * len(kinds), [0] * len(kinds)

        def flushed() -> Iterator[pa.RecordBatch]:
            for k, seen in enumerate(df):
                if seen:
                    yield _rows(CUT, len(seen), k=[k] * len(seen), term=list(seen), df=list(seen.values()), total=[0] * len(seen))
                    seen.clear()

        for made in pieces(batches, any(a.stemming for a in analyzers)):
            yield _rows(CUT, 1, k=[-1], **{c: [made[c]] for c in PARTS})
            part = Part(made, analyzers)
            for k, (size, analyzer) in enumerate(kinds):
                a = analyzers.index(analyzer)
                windows = part.windows(*size)
                length = part.lengths(a, windows)
                n[k] += int((length > 0).sum())
                total[k] += int(length.sum())
                if only is not None:
                    part.keep(a, np.array([t in only[a] for t in part.names[a]], bool))
                seen = np.bincount(part.postings(a, windows)[1], minlength=len(part.names[a])).tolist()
                if only is not None:
                    part.cut.clear()
                for t, x in zip(part.names[a], seen, strict=True):
                    if x:
                        df[k][t] = df[k].get(t, 0) + x
                if len(df[k]) > WORDS:
                    yield from flushed()
        yield from flushed()
        yield _rows(CUT, len(kinds), k=list(range(len(kinds))), df=n, total=total)

    found = written(docs.select("doc_id", "title", "text").mapInArrow(run, "k int, term string, df long, total long, docs array<string>, sents binary, words array<string>, stems array<string>, ids binary"), "cut")
    counted = written(found.filter("k >= 0").groupBy("k", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "term-counts")
    totals = {r.k: (r.df, r.total) for r in counted.filter("term IS NULL").collect()}
    out = []
    for c in configs:
        n, total = totals.get(k := kinds.index((_cut_of(c), c.analyzer)), (0, 0))
        df = F.col("df")
        out.append((n, total, counted.filter((F.col("k") == k) & F.col("term").isNotNull()).select("term", "df", F.log(F.lit(float(n)) / df).alias("idf"), F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("bm25_idf"))))
    return found.filter("k < 0").select(PARTS), out


@dataclass
class Scoring:
    """One search of one index: each query's reach best by base, and what proximity and prior could lift among them."""

    config: IndexConfig
    search: SearchConfig
    reach: int
    average: float
    qids: list[str]
    used: np.ndarray
    terms: dict[str, int]
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    zero: np.ndarray  # terms that all chunks hold
    bounded: bool = True  # whether a chunk's matches bound its proximity


def scoring(config: IndexConfig, search: SearchConfig, reach: int, average: float, rows: list) -> Scoring:
    """rows: the query vector (qid, term, idf, bm25_idf, qw, used), collected."""
    qids = sorted({r.qid for r in rows})
    number, terms = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    rows = sorted(rows, key=lambda r: terms[r.term])
    used, zero = np.zeros(len(qids)), np.zeros(len(terms), bool)
    for r in rows:
        used[number[r.qid]], zero[terms[r.term]] = r.used, r.idf <= 0
    of = np.array([terms[r.term] for r in rows], np.int64)
    weight = np.array([r.qw * (r.bm25_idf if search.method == "bm25" else 1.0) for r in rows])
    return Scoring(config, search, reach, average, qids, used, terms, np.searchsorted(of, np.arange(len(terms) + 1)), np.array([number[r.qid] for r in rows], np.int64), weight, zero)


class _Best:
    """What a task has found for one scoring."""

    def __init__(self, s: Scoring):
        self.s, q = s, len(s.qids)
        self.best, self.kth = np.full((s.reach, q), -1.0), np.full(q, -1.0)
        self.rows: list[tuple] = []
        self.held = 0

    def bound(self, q: np.ndarray, base: np.ndarray, matched: np.ndarray) -> np.ndarray:
        used = self.s.used[q]
        share = matched * (matched - 1) / np.maximum(used * (used - 1), 1)
        return base * (1 + self.s.search.proximity_weight * share) + self.s.search.static_weight >= np.maximum(self.kth[q], 0) - 1e-6

    def add(self, names: np.ndarray, base: np.ndarray, matched: np.ndarray) -> None:
        """base, matched: a row for each chunk, a column for each query."""
        k = self.s.reach
        hot = np.flatnonzero(base.max(0) > self.kth)
        if len(hot):
            new = base[:, hot]
            both = np.vstack([self.best[:, hot], np.partition(new, len(new) - k, axis=0)[len(new) - k :] if len(new) > k else new])
            self.best[:, hot] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
            self.kth[hot] = self.best[:, hot].min(0)
        r, q = np.nonzero(base * (1 + self.s.search.proximity_weight) + self.s.search.static_weight >= np.maximum(self.kth, 0) - 1e-6)
        b, m = base[r, q], matched[r, q]
        keep = (m > 0) & self.bound(q, b, m)
        if keep.any():
            self.rows.append((q[keep], names[r[keep]], b[keep], m[keep]))
            self.held += int(keep.sum())
            if self.held > HELD:
                self.prune()

    def prune(self) -> tuple:
        q, names, b, m = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        keep = self.bound(q, b, m)
        self.rows = [(q[keep], names[keep], b[keep], m[keep])]
        self.held = max(0, int(keep.sum()) - HELD // 2)  # many that stay are not looked at again at once
        return self.rows[0]


class _Champions:
    """The heaviest postings of each query term in a task; ties by chunk id."""

    def __init__(self, s: Scoring):
        self.s, self.size = s, s.config.champions
        self.least, self.last = np.full(len(s.terms), -np.inf), np.full(len(s.terms), "", object)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, term: np.ndarray, heavy: np.ndarray, names: np.ndarray, *more: np.ndarray) -> None:
        heavy = np.where(self.s.zero[term], 0.0, heavy)
        keep = heavy > self.least[term]
        same = np.flatnonzero(heavy == self.least[term])
        keep[same] = (names[same] < self.last[term[same]]).astype(bool)
        self.rows.append((term[keep], heavy[keep], names[keep], *(x[keep] for x in more)))
        self.held += int(keep.sum())
        if self.held > HELD:
            self.prune()

    def prune(self) -> tuple:
        rows = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        order = np.lexsort((np.unique(rows[2].astype(str), return_inverse=True)[1], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        full = place == self.size - 1
        self.least[rows[0][full]], self.last[rows[0][full]] = rows[1][full], rows[2][full]
        self.rows, self.held = [tuple(x[place < self.size] for x in rows)], 0
        return self.rows[0]


FOUND = pa.schema([("s", pa.int32()), ("qid", pa.string()), ("chunk_id", pa.string()), ("base", pa.float64()), ("matched", pa.int64()), ("tf", pa.int64()), ("tf_title", pa.int64()), ("length", pa.int64()), ("norm", pa.float64())])


def scored(made: DataFrame, scorings: list[Scoring], champions: list[Scoring]) -> DataFrame:
    """s, qid, chunk_id, base, matched: for each scoring s what tasks found; for champions (s is -1, -2, ...) with the term in qid
    the tf, tf_title, length, norm of what can be among the terms' champions."""
    every = [*scorings, *champions]
    kinds = list(dict.fromkeys((_cut_of(s.config), s.config.analyzer) for s in every))
    analyzers = list(dict.fromkeys(a for _, a in kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests, champs = [_Best(s) for s in scorings], [_Champions(s) for s in champions]
        for part in (Part(row, analyzers) for batch in batches for row in batch.to_pylist()):
            for kind in kinds:
                a = analyzers.index(kind[1])
                d, idx, *_ = windows = part.windows(*kind[0])
                chunks, term, tf, tf_title, length = part.postings(a, windows)
                names = np.array([f"{part.docs[x]}#{i}" for x, i in zip(d.tolist(), idx.tolist(), strict=True)], object)
                weighed: dict[float, tuple] = {}
                for e, s in enumerate(every):
                    if (_cut_of(s.config), s.config.analyzer) != kind:
                        continue
                    if s.config.zone_weight not in weighed:
                        eff = tf + (s.config.zone_weight - 1.0) * tf_title
                        log = 1 + np.log(eff)
                        weighed[s.config.zone_weight] = eff, log, np.sqrt(np.bincount(chunks, log * log, len(names)))
                    eff, log, norm = weighed[s.config.zone_weight]
                    number = np.array([s.terms.get(t, -1) for t in part.names[a]], np.int64)[term]
                    at = np.flatnonzero(number >= 0)
                    number, c = number[at], chunks[at]
                    if e >= len(scorings):
                        champs[e - len(scorings)].add(number, eff[at], names[c], tf[at], tf_title[at], length[c], norm[c])
                        continue
                    if s.search.method == "bm25":
                        k1, b, x = s.search.k1, s.search.b, eff[at]
                        value = x * (k1 + 1) / (x + k1 * (1 - b + b * length[c] / max(s.average, 1e-9)))
                    else:
                        value = log[at] / norm[c]
                    queries, rows = len(s.qids), max(1, CELLS // max(1, len(s.qids)))
                    for begin in range(0, len(names) if queries else 0, rows):
                        end = min(begin + rows, len(names))
                        lo, hi = np.searchsorted(c, [begin, end])
                        n = s.starts[number[lo:hi] + 1] - s.starts[number[lo:hi]]
                        place = np.arange(int(n.sum())) + np.repeat(s.starts[number[lo:hi]] - np.cumsum(n) + n, n)
                        cell = np.repeat((c[lo:hi] - begin) * queries, n) + s.query[place]
                        base = np.bincount(cell, np.repeat(value[lo:hi], n) * s.weight[place], (end - begin) * queries).reshape(-1, queries)
                        bests[e].add(names[begin:end], base, np.bincount(cell, minlength=(end - begin) * queries).reshape(-1, queries))
        for e, best in enumerate(bests):
            if best.rows:
                q, names, base, matched = best.prune()
                none = [None] * len(q)
                yield pa.RecordBatch.from_pydict({"s": [e] * len(q), "qid": [best.s.qids[i] for i in q.tolist()], "chunk_id": names.tolist(), "base": base, "matched": matched, "tf": none, "tf_title": none, "length": none, "norm": none}, FOUND)
        for e, champ in enumerate(champs):
            if champ.rows:
                term, _, names, *more = champ.prune()
                known, none = list(champ.s.terms), [None] * len(term)
                yield pa.RecordBatch.from_pydict({"s": [-1 - e] * len(term), "qid": [known[i] for i in term.tolist()], "chunk_id": names.tolist(), "base": none, "matched": none, **dict(zip(("tf", "tf_title", "length", "norm"), more, strict=True))}, FOUND)

    return made.mapInArrow(run, "s int, qid string, chunk_id string, base double, matched long, tf long, tf_title long, length long, norm double")


def close_pairs(places: np.ndarray, term: np.ndarray, window: int) -> int:
    """How many pairs of terms come within window of each other; places in order."""
    found: set[int] = set()
    for lag in range(1, len(places)):
        near = np.flatnonzero(places[lag:] - places[:-lag] <= window)
        if not len(near):
            break
        x, y = term[near], term[near + lag]
        found.update((np.minimum(x, y) << 32 | np.maximum(x, y))[x != y].tolist())
    return len(found)


def closeness(docs: DataFrame, pairs: DataFrame, vectors: dict[int, dict[str, list[str]]], configs: list[IndexConfig], windows: list[int]) -> DataFrame:
    """v, qid, chunk_id, window, close of pairs (v, qid, chunk_id): how many pairs of the query's terms (vectors[v][qid]) are within
    each window in the chunk of index v. Only the documents of pairs are cut."""
    analyzers = list(dict.fromkeys(c.analyzer for c in configs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, title, text, asked in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "title", "text", "asked")], strict=True):
                part = Part(cut([(doc_id, title, text)], any(a.stemming for a in analyzers)), analyzers)
                for p in asked:
                    config = configs[p["v"]]
                    a = analyzers.index(config.analyzer)
                    terms, at = part.terms(a)
                    _, _, begin, end = part.windows(*_cut_of(config))
                    i = int(p["chunk_id"].rpartition("#")[2])
                    lo, hi = at[1 + begin[i]], at[1 + end[i]]
                    own = np.concatenate([terms[: at[1]], terms[lo:hi]])
                    places = np.concatenate([np.arange(at[1]), TITLE_GAP + np.arange(hi - lo)])
                    asked_for = set(vectors[p["v"]][p["qid"]])
                    wanted = np.array([t in asked_for for t in part.names[a]], bool)
                    held = np.flatnonzero(wanted[own])
                    held = held[np.argsort(places[held], kind="stable")]
                    for w in windows:
                        for name, value in (("v", p["v"]), ("qid", p["qid"]), ("chunk_id", p["chunk_id"]), ("window", w), ("close", close_pairs(places[held], own[held], w))):
                            rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([("v", pa.int32()), ("qid", pa.string()), ("chunk_id", pa.string()), ("window", pa.int32()), ("close", pa.int64())])
    by_doc = pairs.select(doc_of().alias("doc_id"), F.struct("v", "qid", "chunk_id").alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("asked"))
    return docs.select("doc_id", "title", "text").join(F.broadcast(by_doc), "doc_id").mapInArrow(run, "v int, qid string, chunk_id string, window int, close long")
