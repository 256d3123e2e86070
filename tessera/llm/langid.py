"""Operator 4: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is the sum, over all
ways to cut it into pieces, of the product of the pieces' probabilities; the forward algorithm takes that sum in one pass
over the word. A text's log-probability is the sum over its words, and its posterior over languages (equal priors) gives
the prediction and the score.

Probabilities are fitted by expectation-maximisation over the same sums (forward and backward), on the word counts of a
bounded sample: of each language the PER_LANGUAGE training documents whose id hashes are least, their whole texts. Words
are runs of letters, lower-cased; runs over CHUNK letters are cut into chunks of that length. A letter that is no piece
has a small fixed probability in every language.

Prediction handles the distinct new words of a batch together, as matrices of words of one length, and remembers words up
to a bound. The model is one number for each piece and language; nothing else is sent to the executors or shuffled.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no training document all are `und`; ties
go to the first language in order; texts of any length are read whole; repeated rows get equal results, and in training rows
that repeat an id count once; an empty table gives an empty table; other columns pass through, but for those named like a
result column (lang_pred, score), which the result replaces.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tessera.llm.common import crc32_of, memory, others, spread

PER_LANGUAGE = 300
ROUNDS = 4
CHUNK = 24
UNKNOWN = 1e-7
SMOOTH = 0.05
CACHE = 600_000
_BASE = np.uint64(0x100000001B3)
_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    found = _LETTERS.findall(text.lower())
    if len(text) > CHUNK and any(len(w) > CHUNK for w in found):
        found = [w[k : k + CHUNK] for w in found for k in range(0, len(w), CHUNK)]
    return found


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased; a leading mark stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if re.fullmatch(r"▁?[^\W\d_]*", p) and p)


class Segmenter:
    """Finds the pieces at every place of words, by hashes of substrings in a sorted table."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        assert (self.hashes[1:] != self.hashes[:-1]).all()
        bits = 16
        self.shift = np.uint64(64 - bits)
        self.lead = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    @staticmethod
    def _mix(h):
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(29))

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(14695981039346656037)
        with np.errstate(over="ignore"):
            for c in piece:
                h = (h ^ np.uint64(ord(c))) * _BASE
        return self._mix(h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 for none."""
        h = self._mix(h)
        at = self.lead[(h >> self.shift).astype(np.int64)]
        out = np.full(h.shape, -1, np.int64)
        left = np.arange(len(h))
        last = len(self.hashes)
        while len(left):
            a = at[left]
            inside = a < last
            left, a = left[inside], a[inside]
            here = self.hashes[a]
            hit = here == h[left]
            out[left[hit]] = self.order[a[hit]]
            left = left[here < h[left]]
            at[left] += 1
        return out

    def spans(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(begin, end, piece numbers) of every span of words of one length, the word's start mark included."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)
        h = np.full((len(words), n), 14695981039346656037, np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for width in range(1, min(n, self.longest) + 1):
                h = (h[:, : n - width + 1] ^ codes[:, width - 1 :]) * _BASE
                ids = self.find(h.ravel()).reshape(h.shape)
                out += [(s, s + width, ids[:, s]) for s in range(n - width + 1)]
        return out


def _weights(ids: np.ndarray, width: int, p: np.ndarray) -> np.ndarray:
    w = np.where(ids[:, None] >= 0, p[ids], 0.0)
    return np.where((ids < 0)[:, None], UNKNOWN, w) if width == 1 else w


def forward(spans: list, n: int, p: np.ndarray) -> np.ndarray:
    """(place, word, language): the summed probability of all segmentations of the word up to each place."""
    m = len(spans[0][2])
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1
    for begin, end, ids in sorted(spans, key=lambda x: x[1]):
        if end - begin == 1 or (ids >= 0).any():
            alpha[end] += alpha[begin] * _weights(ids, end - begin, p)
    return alpha


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each piece in each."""
    languages = sorted(counts)
    cut = Segmenter(pieces)
    by_length: dict[int, list[str]] = {}
    for w in sorted({w for c in counts.values() for w in c}):
        by_length.setdefault(len(w), []).append(w)
    groups = [(n + 1, cut.spans(ws), np.array([[counts[g][w] for g in languages] for w in ws], float)) for n, ws in sorted(by_length.items())]
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for n, spans, c in groups:
            alpha = forward(spans, n, p)
            beta = np.zeros_like(alpha)
            beta[n] = 1
            for begin, end, ids in sorted(spans, key=lambda x: -x[0]):
                if end - begin == 1 or (ids >= 0).any():
                    beta[begin] += beta[end] * _weights(ids, end - begin, p)
            scale = c / np.maximum(alpha[n], 1e-300)
            for begin, end, ids in spans:
                hit = ids >= 0
                if hit.any():
                    np.add.at(expected, ids[hit], (alpha[begin] * p[ids] * beta[end] * scale)[hit])
        p = (expected + SMOOTH) / (expected.sum(axis=0) + SMOOTH * len(pieces))
    return languages, p


def train(docs: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The model of docs (doc_id, text, lang), from a sample of at most per_language documents a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = known.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    # bounded by the sample; of rows that repeat an id, the text that comes first counts
    texts = known.join(F.broadcast(drawn.select("lang", "doc_id").distinct()), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(lang, w, n) for lang, text in zip(f["lang"], f["text"], strict=True) for w, n in Counter(words_in(text)).items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    counted = texts.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for lang, word, n in counted.collect():
        counts.setdefault(lang, Counter())[word] = n
    return fit(counts, pieces, rounds) if counts else ([], np.zeros((len(pieces), 0)))


class Scorer:
    """Log-probabilities of words in each language, remembered up to a bound."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.cut, self.p = Segmenter(pieces), p
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.used = np.zeros((1 << 16, self.p.shape[1])), 0

    def learn(self, words: set[str]) -> None:
        if len(self.at) > CACHE:
            self.forget()
        by_length: dict[int, list[str]] = {}
        for w in words.difference(self.at):
            by_length.setdefault(len(w), []).append(w)
        for n, ws in by_length.items():
            for k in range(0, len(ws), 20_000):
                some = ws[k : k + 20_000]
                found = np.log(np.maximum(forward(self.cut.spans(some), n + 1, self.p)[n + 1], 1e-300))
                self.at.update(zip(some, range(self.used, self.used + len(some)), strict=True))
                while self.used + len(some) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[self.used : self.used + len(some)] = found
                self.used += len(some)

    def text(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)


def predict(docs: DataFrame, pieces: list[str], languages: list[str], p: np.ndarray) -> DataFrame:
    """docs with lang_pred and score, from text alone."""
    send = docs.sparkSession.sparkContext.broadcast((pieces, languages, p))
    model = uuid.uuid4().hex
    own = others(docs, "lang_pred", "score")
    schema = StructType([*docs.select(*own).schema])
    place, names = [f.name.lower() for f in schema].index("text"), [*schema.names, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, p = send.value
        scorer = memory(model, lambda: Scorer(pieces, p)) if languages else None
        for batch in batches:
            best: list[str] = []
            sure: list[float] = []
            for k in range(0, batch.num_rows, 500):  # a bounded share of the batch at a time
                words = [words_in(t) if t is not None else [] for t in batch.column(place).slice(k, 500).to_pylist()]
                if scorer:
                    scorer.learn({w for ws in words for w in ws})
                for ws in words:
                    if not ws or not scorer:
                        best.append("und")
                        sure.append(0.0)
                        continue
                    x = scorer.text(ws)
                    i = int(x.argmax())
                    best.append(languages[i])
                    sure.append(float(1 / np.exp(x - x[i]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())], names)

    return docs.select(*own).mapInArrow(run, schema.add("lang_pred", StringType()).add("score", DoubleType()))


def op4_langid(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc32_of(F.col("doc_id")) % 4 == 2
    pieces = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    languages, p = train(docs.filter(~held_out), pieces)
    rows = spread(docs.select("doc_id", "text", held_out.alias("held_out")))
    return predict(rows, pieces, languages, p).select("doc_id", "held_out", "lang_pred", "score")
