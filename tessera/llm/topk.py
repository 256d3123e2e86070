"""Operator 2: exact top-k inner products by pivot-table elimination.

Pivots are PIVOTS rows of a bounded sample; the table holds every vector's distance to every pivot. For a query q, a
candidate x and any pivot p the distance |q - x| is at least |d(q, p) - d(x, p)|, so the greatest of these lower bounds
caps the inner product: q.x <= (|q|^2 + |x|^2 - bound^2) / 2.

Vectors are dealt into blocks of about BLOCK rows of one cell (the nearest pivot), large cells being split by a hash, and
so are the queries. A first pass evaluates every query block against its own cell, which gives each query a k-th score.
A query block then meets only those blocks whose caps, from the interval of their pivot distances, reach a query's k-th
score; within a met block the candidates are taken in the order of their caps, in steps that double, until the next cap falls
below the k-th score. Each meeting returns at most k rows a query; these are merged. All numbers are integers, so scores are
exact, and bounds are rounded outward, so no candidate is lost. Blocks whose products could exceed 2**53 are evaluated in
whole numbers of any size, without elimination.

How much is eliminated depends on the data: on clustered vectors most block pairs never meet; on vectors without clusters the
distances concentrate, and hardly anything can be ruled out (the README has figures).

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors count as padded
with zeros; ties go to the smaller id; rows with a null id take no part, as they can be neither named nor excluded; of rows
that repeat a query's id, all are its own and none is its candidate; repeated rows of another id are candidates each; an empty
table gives an empty table; other columns are not read. Scores beyond a long count as the greatest or least long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

PIVOTS = 16
SAMPLE = 2000
BLOCK = 2048
#: Candidates evaluated first; each further step takes twice as many.
STEP = 128
#: Sums up to here are exact in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of the sample, beginning at its first."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    vectors, pivots = vectors - pivots[0], pivots - pivots[0]  # near zero, what cancels is small
    square = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Packed:
    """A block of vectors as it travels: ids, vectors and pivot distances."""

    def __init__(self, row, width: int, pivots: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        self.table = np.frombuffer(row["dist"], np.float64).reshape(-1, pivots)
        self.norms = (self.vectors**2).sum(axis=1)
        self.most = float(np.abs(self.vectors).max(initial=0))


def caps(q: Packed, x: Packed) -> np.ndarray:
    """For each query and candidate, what their inner product cannot exceed; minus infinity for a query itself."""
    far = max(q.table.max(initial=0), x.table.max(initial=0))
    kind, lost = (np.float32, 1e-5 * far) if far < 1e4 else (np.float64, 1e-7 * far)  # far more than rounding loses
    mine, theirs = q.table.astype(kind), x.table.astype(kind)
    bound = np.zeros((len(q.ids), len(x.ids)), kind)
    gap = np.empty_like(bound)
    for p in range(mine.shape[1]):
        np.subtract(mine[:, p, None], theirs[None, :, p], out=gap)
        np.maximum(bound, np.abs(gap, out=gap), out=bound)
    bound = np.maximum(bound.astype(np.float64) - lost, 0)
    both = q.norms[:, None] + x.norms[None, :]
    cap = (both - bound**2) / 2 + 1e-9 * both
    cap[q.ids[:, None] == x.ids[None, :]] = -np.inf
    return cap


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in vectors.ravel().tolist()], object).reshape(vectors.shape)


def meet(q: Packed, x: Packed, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of q: (id, ids, scores) of its k best in x; least: known k-th scores."""
    if q.most * x.most * x.vectors.shape[1] >= EXACT:
        theirs = _whole(x.vectors)
        for me, v, kth in zip(q.ids.tolist(), _whole(q.vectors), least, strict=True):
            scores = np.array([max(-LONG - 1, min(LONG, s)) for s in theirs @ v], np.int64)
            good = np.flatnonzero((x.ids != me) & (scores >= kth * (1 - np.sign(kth) * 1e-9)))  # kth has been rounded
            if len(good):
                yield me, *_best(x.ids[good], scores[good], k)
        return
    cap = caps(q, x)
    for i, me in enumerate(q.ids.tolist()):
        able = np.flatnonzero((cap[i] >= least[i]) & (cap[i] > -np.inf))
        able = able[np.argsort(-cap[i, able])]
        kth, scores, at, step = least[i], np.empty(0), 0, max(STEP, k)
        while at < len(able) and cap[i, able[at]] >= kth:
            scores = np.r_[scores, x.vectors[able[at : at + step]] @ q.vectors[i]]
            at, step = at + step, step * 2
            if len(scores) >= k:
                kth = max(kth, np.partition(scores, len(scores) - k)[len(scores) - k])
        good = np.flatnonzero(scores >= kth)
        if len(good):
            yield me, *_best(x.ids[able[good]], scores[good].astype(np.int64), k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: vec_id long, vector array<double> of integers; is_query: a column over vec_id.
    report gets the numbers of block pairs that meet and that there are."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull())
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if width is None:
        return empty
    width = max(width, 1)
    drawn = rows.select("vector", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    chosen = choose_pivots(_matrix([r["vector"] for r in drawn], width), pivots)
    n_pivots = len(chosen)

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = _matrix(f["vector"].tolist(), width)
            d = _distances(m, chosen)
            yield pd.DataFrame({"vec_id": f["vec_id"], "is_query": f["is_query"], "cell": d.argmin(axis=1).astype(np.int32), "v": [r.tobytes() for r in m], "d": [r.tobytes() for r in d]})

    tabled = written(rows.select("vec_id", is_query.alias("is_query"), "vector").mapInPandas(table, "vec_id long, is_query boolean, cell int, v binary, d binary"), "pivots")
    counts = {r["cell"]: (r["n"], r["q"]) for r in tabled.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).collect()}  # one row a pivot

    def blocks(df: DataFrame, of: int, name: str) -> DataFrame:
        splits = F.element_at(F.create_map(*[F.lit(int(x)) for c in counts for x in (c, max(1, math.ceil(counts[c][of] / block)))]), F.col("cell"))

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            v, d = (np.frombuffer(b"".join(f[c]), np.float64) for c in ("v", "d"))
            t = d.reshape(-1, n_pivots)
            norms = (v.reshape(-1, width) ** 2).sum(axis=1)
            return pd.DataFrame([(f["cell"].iloc[0], f["sub"].iloc[0], f["vec_id"].to_numpy(np.int64).tobytes(), v.tobytes(), d.tobytes(), t.min(axis=0).tolist(), t.max(axis=0).tolist(), float(norms.max()), norms.tobytes())], columns=["cell", "sub", "ids", "vectors", "dist", "lo", "hi", "norm", "norms"])

        dealt = df.withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(11)), splits).cast("int"))
        return written(dealt.groupBy("cell", "sub").applyInPandas(pack, "cell int, sub int, ids binary, vectors binary, dist binary, lo array<double>, hi array<double>, norm double, norms binary"), name)

    candidates = blocks(tabled, 0, "candidates")
    queries = blocks(tabled.filter("is_query"), 1, "queries")

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                q = Packed({"ids": row["q_ids"], "vectors": row["q_vectors"], "dist": row["q_dist"]}, width, n_pivots)
                x = Packed(row, width, n_pivots)
                kth = row.get("kth")
                least = np.full(len(q.ids), -np.inf) if kth is None else np.frombuffer(kth, np.float64)
                for me, ids, scores in meet(q, x, least, k):
                    out.append(pd.DataFrame({"query_id": me, "vec_id": ids, "score": scores}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = "query_id long, vec_id long, score long"
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    # the first pass: a query block against one block of its own cell
    own = q.join(candidates.filter("sub = 0"), q["q_cell"] == candidates["cell"])
    first = own.mapInPandas(met, found)
    kths = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("kth"))
    member = tabled.filter("is_query").select("vec_id", "cell").distinct()

    def limits(f: pd.DataFrame, kth: pd.DataFrame) -> pd.DataFrame:
        """A query block with its queries' k-th scores in the order of its ids."""
        known = dict(zip(kth["query_id"], kth["kth"], strict=True))
        out = f.copy()
        out["kth"] = [np.array([known.get(i, -np.inf) for i in np.frombuffer(b, np.int64).tolist()], np.float64).tobytes() for b in f["ids"]]
        return out

    by_cell = kths.join(member, kths["query_id"] == member["vec_id"]).filter("kth IS NOT NULL").withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.element_at(F.create_map(*[F.lit(int(x)) for c in counts for x in (c, max(1, math.ceil(counts[c][1] / block)))]), F.col("cell"))).cast("int"))
    types = "cell int, sub int, ids binary, vectors binary, dist binary, lo array<double>, hi array<double>, norm double, norms binary"
    ready = written(queries.groupBy("cell", "sub").cogroup(by_cell.select("cell", "sub", "query_id", "kth").groupBy("cell", "sub")).applyInPandas(limits, types + ", kth binary"), "ready")
    # block summaries are a few numbers a block; the pairs of blocks that can still matter are listed from them
    span = candidates.select(F.col("cell").alias("x_cell"), F.col("sub").alias("x_sub"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.col("norm").alias("x_norm"))

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                table, norms = np.frombuffer(row["dist"], np.float64).reshape(-1, n_pivots), np.frombuffer(row["norms"], np.float64)
                kth = np.frombuffer(row["kth"], np.float64)
                for s in row["spans"]:
                    gap = np.maximum(np.maximum(np.asarray(s["x_lo"])[None] - table, table - np.asarray(s["x_hi"])[None]), 0).max(axis=1)
                    both = norms + s["x_norm"]
                    lost = 1e-7 * max(table.max(), max(s["x_hi"]))
                    cap = (both - np.maximum(gap - lost, 0) ** 2) / 2 + 1e-9 * both
                    if (cap >= kth).any():
                        out.append((row["cell"], row["sub"], s["x_cell"], s["x_sub"]))
            yield pd.DataFrame(out, columns=["q_cell", "q_sub", "cell", "sub"])

    groups = max(1, sum(math.ceil(n / block) for n, _ in counts.values()) // 500)
    grouped = span.groupBy(F.pmod(F.xxhash64("x_cell", "x_sub"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("x_cell", "x_sub", "x_lo", "x_hi", "x_norm")).alias("spans"))
    copies = ready.select("cell", "sub", "norms", "dist", "kth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    pairs = copies.join(grouped, "g").mapInPandas(reach, "q_cell int, q_sub int, cell int, sub int")
    if report is not None:
        pairs = written(pairs, "pairs")
        report |= {"met": pairs.count(), "all": queries.count() * candidates.count()}
    q2 = ready.select(*[F.col(c).alias(c if c == "kth" else f"q_{c}") for c in ready.columns])
    second = pairs.join(q2.select("q_cell", "q_sub", "q_ids", "q_vectors", "q_dist", "kth"), ["q_cell", "q_sub"]).join(candidates.select("cell", "sub", "ids", "vectors", "dist"), ["cell", "sub"]).mapInPandas(met, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = raw.filter(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = finite.select("vec_id", F.transform("e", lambda x: F.floor(x * 64).cast("double")).alias("vector"))
    return top_k(scaled, F.col("vec_id") % 20 == 0)
