"""Operator 9: language-model scoring with a weighted backoff automaton.

The model is an n-gram automaton of order ORDER over words. Its states are histories: the empty one, the start of a text, and
every n-gram of fewer than ORDER words that training holds. From state h an arc for token w exists where training holds h w; it
weighs log10 of the smoothed
    P(w | h) = (c(h w) + MASS * P(w | h')) / (c(h) + MASS),     h' = h without its first word,
and leads to the state of h w, or of its longest end that is one. Where there is no arc, the failure arc of h weighs
log10(MASS / (c(h) + MASS)) and leads to h', down to the empty state, which has an arc for every token:
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Each state's probabilities sum to one. A text is traversed once from left to right,
carrying the state and adding up the weights passed. Many places are traversed in step: texts are cut into stretches, and as a
state depends on ORDER - 1 tokens only, a stretch that starts so many tokens early from the empty state has the true one.

The automaton grows with the corpus and is never gathered in one place. Each task turns its texts into blocks of a bounded
size (tokens as numbers of a block's own vocabulary) that are written once. Then, level by level, a block sends its distinct
(state, word) pairs with their training counts to parts of the key space; a part sums what all blocks sent, numbers the
n-grams that training holds (these numbers are the states of the next level), and answers each block in the order asked. So
keys are exact, no hash stands for a word or an n-gram. Pairs whose state or word training lacks are not sent. Parts follow
the size of what is sent, blocks that of the texts; a message holds all that one block has for one part, so there are never
more messages than distinct pairs of blocks. Counts are of all training texts, without thresholds.

Defined cases: a null text counts as empty, whose only token is the end; texts of any length are scored whole; repeated
rows count and are scored each; ids may be null, and of any type that text can stand for; with no training text, N and V are 0
and every token is unknown; an empty table gives an empty table; of the input only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_of, memory, spread, written

ORDER = 3
#: Weight of the shorter history's distribution in every state, in tokens.
MASS = 2.0
#: Bytes of text a block holds (a longer text is a block by itself), and of messages a part sums, on average.
BLOCK, PART = 8_000_000, 12_000_000
#: Tokens traversed in step of each stretch.
STRETCH = 256
#: Numbers of the start and the end among words; others follow.
START, END, FIRST = 0, 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCKS = "block long, ids array<string>, held binary, lengths binary, tokens long, training long, words binary, own binary, at binary"
ASKED = "part int, block long, n int, states binary, words binary, counts binary"
ANSWERED = "level int, part int, block long, n int, counts binary, ranks binary, tokens long, known long"
SCORED = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each, by significance."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Numbers that never fall, as differences."""
    return packed(np.diff(x, prepend=0))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, sorted; a place of each; and of every place its key's number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _cut(limit: int):
    """Rows of (id, text, held_out) -> blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        task, made = TaskContext.get().partitionId(), 0
        ids, held, rows, size, numbers = [], [], [], 0, _Numbers({b"": 0})

        def block() -> pd.DataFrame:
            lengths = np.array([len(r) for r in rows], np.int64)
            at = np.concatenate(rows)
            training = np.repeat(~np.array(held, bool), lengths)
            own = np.bincount(at[training], minlength=len(numbers))
            row = ((task << 24) + made, ids, np.array(held, bool).tobytes(), packed(lengths), len(at), held.count(False), b" ".join(list(numbers)[1:]), packed(own), packed(at))
            return pd.DataFrame([row], columns=["block", "ids", "held", "lengths", "tokens", "training", "words", "own", "at"])

        for f in frames:
            for i, text, h in zip(f["id"], f["text"], f["held_out"], strict=True):
                words = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(i)
                held.append(bool(h))
                rows.append(np.array([*map(numbers.__getitem__, words), 0], np.int64))
                size += 0 if not isinstance(text, str) else len(text)
                if size >= limit or len(rows) >= 100_000:
                    yield block()
                    made += 1
                    ids, held, rows, size, numbers = [], [], [], 0, _Numbers({b"": 0})
        if rows:
            yield block()

    return run


class Block:
    """A block's tokens and the distinct n-grams in them, with what is known of their counts.

    Level 1 are the words of the block's vocabulary (the end is number 0). A gram of level k is a gram of level k - 1, or the
    start, and a word; it exists at places that have so many tokens before them in their text, the start counting as one.
    """

    def __init__(self, row, order: int):
        self.row, self.order = row, order
        n_texts = len(row["ids"])
        self.lengths = unpacked(row["lengths"], n_texts)
        self.held = np.frombuffer(row["held"], bool)
        self.size = int(row["tokens"])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.words = row["words"].split(b" ") if row["words"] else []
        self.vocabulary = len(self.words) + 1
        self.at = {1: unpacked(row["at"], self.size)}
        self.own = {1: unpacked(row["own"], self.vocabulary)}
        self.history: dict[int, np.ndarray] = {}  # of each gram: its gram of the level below, or of level 2 a word, the start being the vocabulary's size
        self.word = {1: np.arange(self.vocabulary)}
        self.suffix: dict[int, np.ndarray] = {}  # of each gram: the gram of the level below without its first word
        self.count: dict[int, np.ndarray] = {}
        self.number: dict[int, np.ndarray] = {}
        self.sent: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rise(self, level: int) -> None:
        """Finds the grams of a level from those below it."""
        before = np.empty(self.size, np.int64)
        before[1:] = self.at[level - 1][:-1]
        before[self.begins] = self.vocabulary if level == 2 else -1
        places = slice(None) if level == 2 else np.flatnonzero(before >= 0)
        keys = before[places] * self.vocabulary + self.at[1][places]
        keys, first, inverse = distinct(keys)
        at = inverse if level == 2 else np.full(self.size, -1, np.int64)
        if level > 2:
            at[places] = inverse
            first = places[first]
        self.at[level] = at
        self.history[level], self.word[level] = np.divmod(keys, self.vocabulary)
        self.suffix[level] = self.at[level - 1][first]
        training = np.repeat(~self.held, self.lengths)
        if level > 2:
            training &= at >= 0
        self.own[level] = np.bincount(at[training], minlength=len(keys))

    def parts_of_words(self, parts: int) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.words), np.uint64, len(self.words)) % np.uint64(parts)

    def asks(self, level: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The grams of a level that are sent, sorted by part, state and word; the part, state and word of each."""
        history, words = self.history[level], self.word[level]
        if level == 2:
            start = history == self.vocabulary
            inner = np.where(start, 0, history)
            known, state = start | (self.count[1][inner] > 0), np.where(start, START, self.number[1][inner])
        else:
            known, state = self.count[level - 1][history] > 0, self.number[level - 1][history]
            known &= self.count[level - 1][self.suffix[level]] > 0
        some = np.flatnonzero(known & (self.count[1][words] > 0))
        state, word = state[some], self.number[1][words[some]]
        with np.errstate(over="ignore"):
            mixed = (state.astype(np.uint64) * _A) ^ (word.astype(np.uint64) * _B)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _B
        part = ((mixed >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        wide = int(word.max(initial=0)) + 1
        order = np.argsort(state * wide + word) if int(state.max(initial=0)) < (1 << 63) // wide else np.lexsort((word, state))
        order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
        return some[order], part[order], state[order], word[order]

    def learn(self, level: int, parts: int, answers: pd.DataFrame, texts: int) -> None:
        """Takes in the answers of a level's parts."""
        if level == 1:
            part = self.parts_of_words(parts).astype(np.int64)
            grams = np.argsort(part, kind="stable")
            part, grams = part[grams], grams + 1
        else:
            grams, part, _, _ = self.asks(level, parts)
        size = len(self.word[level])
        count, number = np.zeros(size, np.int64), np.zeros(size, np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p, n, c, r in zip(answers["part"], answers["n"], answers["counts"], answers["ranks"], strict=True):
            mine = grams[cuts[p] : cuts[p + 1]]
            count[mine] = unpacked(c, n)
            ranks = unpacked(r, n) if r is not None and len(r) else np.zeros(n, np.int64)
            number[mine] = (ranks if level == 1 else np.cumsum(ranks)) * parts + p + (FIRST if level == 1 else 0)
        if level == 1:
            count[0], number[0] = texts, END
        self.count[level], self.number[level] = count, number


def _ask_words(parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                words = row["words"].split(b" ") if row["words"] else []
                own = unpacked(row["own"], len(words) + 1)[1:]
                part = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    mine = order[cuts[p] : cuts[p + 1]]
                    if len(mine):
                        out.append((p, row["block"], len(mine), None, b" ".join([words[i] for i in mine.tolist()]), packed(own[mine])))
                yield pd.DataFrame(out, columns=["part", "block", "n", "states", "words", "counts"])

    return run


def _answer_words(parts: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        numbers = _Numbers()
        at = [np.fromiter(map(numbers.__getitem__, w.split(b" ")), np.int64, n) for w, n in zip(f["words"], f["n"], strict=True)]
        total = np.zeros(len(numbers), np.int64)
        for a, c, n in zip(at, f["counts"], f["n"], strict=True):
            total[a] += unpacked(c, n)
        rank = np.cumsum(total > 0) - 1
        out = f[["part", "block", "n"]].copy()
        out.insert(0, "level", 1)
        out["counts"] = [packed(total[a]) for a in at]
        out["ranks"] = [packed(np.where(total[a] > 0, rank[a], 0)) for a in at]
        out["tokens"], out["known"] = int(total.sum()), int((total > 0).sum())
        return out

    return run


def _answer_grams(level: int, last: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        sizes = f["n"].tolist()
        states = np.concatenate([np.cumsum(unpacked(s, n)) for s, n in zip(f["states"], sizes, strict=True)])
        words = np.concatenate([unpacked(w, n) for w, n in zip(f["words"], sizes, strict=True)])
        low, wide = int(states.min()), int(words.max()) + 1
        if (int(states.max()) - low + 1) * wide < 1 << 63:
            _, _, at = distinct((states - low) * wide + words)
        else:
            order = np.lexsort((words, states))
            new = np.r_[True, (np.diff(states[order]) != 0) | (np.diff(words[order]) != 0)]
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
        total = np.zeros(int(at.max()) + 1, np.int64)
        cuts = np.cumsum([0, *sizes])
        for a, b, c in zip(cuts[:-1], cuts[1:], f["counts"], strict=True):
            total[at[a:b]] += unpacked(c, b - a)  # a message names each pair once
        rank = np.maximum(np.cumsum(total > 0) - 1, 0)
        out = f[["part", "block", "n"]].copy()
        out.insert(0, "level", level)
        out["counts"] = [packed(total[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out["ranks"] = [None if last else rising(rank[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out["tokens"], out["known"] = 0, 0
        return out

    return run


def _informed(docs: pd.DataFrame, answers: pd.DataFrame, order: int, parts: dict[int, int], texts: int) -> Block:
    block = Block(docs.iloc[0], order)
    for level in range(1, max(parts) + 1):
        if level > 1:
            block.rise(level)
        block.learn(level, parts[level], answers[answers["level"] == level], texts)
    return block


def _ask_grams(level: int, order: int, parts: dict[int, int], wanted: int, texts: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        memory()
        out = []
        if len(docs):
            block = _informed(docs, answers, order, parts, texts)
            block.rise(level)
            grams, part, states, words = block.asks(level, wanted)
            counts = block.own[level][grams]
            cuts = np.searchsorted(part, np.arange(wanted + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[p], cuts[p + 1])
                out.append((p, docs["block"].iloc[0], s.stop - s.start, rising(states[s]), packed(words[s]), packed(counts[s])))
        return pd.DataFrame(out, columns=["part", "block", "n", "states", "words", "counts"])

    return run


class Automaton:
    """The states and arcs that a block's texts can reach.

    States are numbered: 0 the empty history, then the block's words, the start, and its grams by level. level, fail and shorter
    are of states: words of history, weight and target of the failure arc. weight and target are of grams, that is of arcs (the
    history's state, the word); has tells which exist.
    """

    def __init__(self, block: Block, tokens: int, known: int, texts: int, mass: float):
        self.block, order = block, block.order
        self.start = block.vocabulary + 1
        seen = {1: np.append(block.count[1], texts), **{k: block.count[k] for k in range(2, order + 1)}}
        base = {1: 1}
        for k in range(2, order):
            base[k] = base[k - 1] + len(seen[k - 1])
        p = {1: (block.count[1] + 0.5) / (tokens + 0.5 * (known + 1))}
        self.level, self.fail, self.shorter = [np.zeros(1, np.int8)], [np.zeros(1)], [np.zeros(1, np.int64)]
        self.has, self.target = {1: block.count[1] > 0}, {1: np.where(block.count[1] > 0, base[1] + np.arange(block.vocabulary), 0)}
        for k in range(1, order):
            c = seen[k].astype(float)
            self.level.append(np.where(c > 0, k, 0).astype(np.int8))
            self.fail.append(np.log10(mass / (c + mass)))
            self.shorter.append(np.zeros(len(c), np.int64) if k == 1 else self.target[k - 1][block.suffix[k]])
            above = c[block.history[k + 1]]
            p[k + 1] = (block.count[k + 1] + mass * p[k][block.suffix[k + 1]]) / (above + mass)
            self.has[k + 1] = block.count[k + 1] > 0
            lower = self.target[k][block.suffix[k + 1]]
            self.target[k + 1] = np.where(self.has[k + 1], base[k + 1] + np.arange(len(lower)), lower) if k + 1 < order else lower
        self.level, self.fail, self.shorter = map(np.concatenate, (self.level, self.fail, self.shorter))
        # one more for places without a gram of a level, whose number is -1
        self.weight = {k: np.append(np.log10(x), 0.0) for k, x in p.items()}
        self.has = {k: np.append(x, False) for k, x in self.has.items()}
        self.target = {k: np.append(x, 0) for k, x in self.target.items()}

    def traverse(self, stretch: int = STRETCH) -> np.ndarray:
        """The weight passed at each token, the texts read from left to right, in step by stretches."""
        block, order = self.block, self.block.order
        pieces = -(-block.lengths // stretch)
        text = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counted = block.begins[text] + nth * stretch  # where a stretch's own tokens begin
        end = np.minimum(counted + stretch, block.begins[text] + block.lengths[text])
        place = np.maximum(counted - (order - 1), block.begins[text])
        state = np.where(place == block.begins[text], self.start if block.size else 0, 0)
        longest = np.argsort(place - end, kind="stable")
        place, end, counted, state = place[longest], end[longest], counted[longest], state[longest]
        out = np.zeros(block.size)
        live = len(place)
        while live:
            i, now = place[:live], state[:live].copy()
            passed, open_, ahead = np.zeros(live), np.ones(live, bool), np.zeros(live, np.int64)
            for k in range(order, 0, -1):
                here = open_ & (self.level[now] == k - 1)
                gram = block.at[k][i]
                arc = here if k == 1 else here & self.has[k][gram]
                passed += np.where(arc, self.weight[k][gram], 0.0)
                ahead = np.where(arc, self.target[k][gram], ahead)
                open_ &= ~arc
                falls = here & ~arc
                passed += np.where(falls, self.fail[now], 0.0)
                now = np.where(falls, self.shorter[now], now)
            mine = i >= counted[:live]
            out[i[mine]] = passed[mine]
            state[:live] = ahead
            place[:live] += 1
            while live and place[live - 1] >= end[live - 1]:
                live -= 1
        return out


def _scored(order: int, parts: dict[int, int], tokens: int, known: int, texts: int, mass: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in ("id", "held_out", "n_tokens", "n_known", "base_score", "score")})
        block = _informed(docs, answers, order, parts, texts)
        auto = Automaton(block, tokens, known, texts, mass)
        add = lambda x: np.add.reduceat(x, block.begins)
        at = block.at[1]
        return pd.DataFrame({"id": pd.Series(list(docs["ids"].iloc[0]), dtype=object), "held_out": block.held, "n_tokens": block.lengths, "n_known": add((block.count[1] > 0)[at].astype(np.int64)), "base_score": add(auto.weight[1][at]), "score": add(auto.traverse())})

    return run


def score(docs: DataFrame, held_out, order: int = ORDER, block_bytes: int = BLOCK, part_bytes: int = PART, mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; held_out (a column) marks the texts that are not learnt."""
    if order < 2:
        raise ValueError("an automaton needs histories: order 2 or more")
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = written(spread(rows).mapInPandas(_cut(block_bytes), BLOCKS), "blocks", "zstd")
    total, size, texts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (F.col("tokens"), F.octet_length("words"), F.col("training"))]).first()
    parts = {1: max(1, math.ceil(size / part_bytes))}
    asked = blocks.select("block", "words", "own").mapInPandas(_ask_words(parts[1]), ASKED)
    answers = written(asked.groupBy("part").applyInPandas(_answer_words(parts[1]), ANSWERED), "answers", "zstd")
    # one row a part is enough: each of its answers says the same
    tokens, known = answers.groupBy("part").agg(F.max("tokens").alias("t"), F.max("known").alias("k")).agg(F.coalesce(F.sum("t"), F.lit(0)) + texts, F.coalesce(F.sum("k"), F.lit(0)) + int(texts > 0)).first()

    def together(function, schema):
        return blocks.groupBy("block").cogroup(answers.select("level", "part", "block", "n", "counts", "ranks").groupBy("block")).applyInPandas(function, schema)

    for level in range(2, order + 1):
        wanted = max(1, math.ceil(total * 5 / part_bytes))  # about five bytes a token at most
        asked = together(_ask_grams(level, order, dict(parts), wanted, texts), ASKED)
        answers = answers.unionByName(written(asked.groupBy("part").applyInPandas(_answer_grams(level, level == order), ANSWERED), "answers", "zstd"))
        parts[level] = wanted
    out = together(_scored(order, parts, tokens, known, texts, mass), SCORED)
    return out.select(F.col("id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, crc32_of(F.col("doc_id")) % 5 == 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
