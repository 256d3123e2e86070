"""Near-duplicates of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

All such pairs are found, and no others: the components of exactly those links are the groups. Documents with one set of
shingles are one from the start, so copies cost nothing further. Shingles stand as 64-bit hashes.

Most texts have no near copy, and they go first. Of a set of n that is similar to another at most a fifth of the shingles are in
no other set. A fixed share of all hashes (DRAWN of 8) is counted over all texts, and a set of which more of these than that are
nowhere else is done with: it is in no pair, so the sets that stay may also do without it in all that follows.

For those that stay, shingles are counted once more, now all of them, and ordered from the rarest. Two sets of similarity 0.8
share at least 0.8 of either, so under any one order of all shingles their prefixes (a fifth of each set and one more) meet in a
shingle; those in one set alone come first and meet nothing.

Links come in three steps, and what is connected needs no comparison any more. SimHash: sets of one fingerprint, and those that
the pivot tables of operator 3 link. Leaders: two rounds link the members of a key to one each (the member that meets most
others, then one by hash). Then the members of a key that are still apart are compared by a sketch: how many shingles fall into
each of some buckets (256, more for long texts). Sets differ in at least as many shingles as these counts differ, so what the
sketches discard is below 0.8 for certain. What they do not discard becomes a spanning forest a key, and the components of all
forests hold every pair that could link; within a component the whole sets are compared, again into a spanning forest. Sets travel
as one row for each key or component (of over CHUNK, or over WEIGHT shingles: one for each chunk it meets), never as pairs, and no
step returns more rows than it was dealt. Keys with the same members are compared once. Every link of all steps is held against the
whole sets.

Defined cases: shingles are of ASCII-lowered words, a shorter text is one shingle; null and blank texts have the empty set
and form one group; texts of any length are read whole; rows with a null id take part; of repeated rows one stays; an empty
table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, id_as_text, id_back, memory, row_keys, scratch, spread, written
from tessera.llm.simhash import SEED, components, fingerprint_of, links, roots, shingle_hashes

#: The similarity is NUM / DEN.
NUM, DEN = 4, 5
SHINGLE = 5
#: Shingles that so many sets have are alike in the order, which decides nothing but the work.
FREQUENT = 1_000
#: Of all hashes so many in 8 are counted first.
DRAWN = 3
#: Keys (rows, sets) up to which they are broadcast (some MB).
BROADCAST = 1_000_000
#: Links up to which one task finds their components (some MB).
FEW = 200_000
#: Members of a key that are held together.
CHUNK = 512
#: Shingles of whole sets that are held together (8 MB).
WEIGHT = 1 << 20
#: Buckets of a sketch, doubled until they are half as many as the shingles.
BUCKETS = 256


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted as signed longs."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def prefix_length(n: int) -> int:
    """Of n shingles, how many must be looked at to meet every set that is similar enough."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def similar(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m with common shared ones reach the similarity, in whole numbers."""
    return common * (NUM + DEN) >= (n + m) * NUM


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = row_keys()
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def _light(df: DataFrame) -> DataFrame:
    """df (written), to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _sid(h: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch_of(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each bucket, 255 at most."""
    width = BUCKETS
    while 2 * width < len(h):
        width *= 2
    return np.minimum(np.bincount(h & (width - 1), minlength=width), 255).astype(np.uint8).tobytes()


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, k1 and k2 (of the row), sid and n (of the set) and drawn (the counted share of its hashes) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for f in frames:
            for k in range(0, len(f), 500):
                part = f.iloc[k : k + 500]
                h = [shingles(x if isinstance(x, str) else None, shingle) for x in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "k1": part["k1"].to_numpy(), "k2": part["k2"].to_numpy(), "sid": [_sid(x) for x in h], "n": [len(x) for x in h], "drawn": [x[(x & 7) < DRAWN] for x in h]})

    rows = spread(_keyed(docs)).withColumn("doc_id", id_as_text())
    return id_back(rows.mapInPandas(run, "doc_id string, k1 long, k2 long, sid long, n long, drawn array<long>"), docs)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """sid, n, fp (fingerprint), sketch and h (the set) of the rows' texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        for f in frames:
            for k in range(0, len(f), 500):
                every = [shingle_hashes(x if isinstance(x, str) else None, shingle) for x in f["text"].iloc[k : k + 500]]
                h = [np.unique(x.view(np.int64)) for x in every]
                yield pd.DataFrame({"sid": [_sid(x) for x in h], "n": [len(x) for x in h], "fp": np.array([fingerprint_of(x) for x in every], np.uint64).view(np.int64), "sketch": [sketch_of(x) for x in h], "h": h})

    return rows.select("text").mapInPandas(run, "sid long, n long, fp long, sketch binary, h array<long>")


def _prefix(n: Column) -> Column:
    """prefix_length as a column, of n over 0."""
    return n - F.floor((n * NUM + (DEN - 1)) / DEN) + 1


def _staying(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Of the distinct sets, those with so few drawn shingles of their own that they can be in a pair."""
    keyed = found.select("sid", F.explode("drawn").alias("key"))
    alone = keyed.groupBy("key").agg(F.min("sid").alias("one"), F.max("sid").alias("last")).filter("one = last").groupBy("one").agg(F.count("*").alias("alone"))
    return distinct.join(alone, F.col("sid") == F.col("one"), "left").filter((F.col("n") > 0) & (F.coalesce("alone", F.lit(0)) < _prefix(F.col("n")))).select("sid", "rep")


def _keys(held: DataFrame) -> DataFrame:
    """sid, n, key: of every set the shingles of its prefix that other sets have too."""
    each = held.select("sid", "n", F.explode("h").alias("key"))
    shared = each.select("key").groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    order = F.sort_array(F.collect_list(F.struct(F.least("df", F.lit(FREQUENT)).alias("df"), "key")))
    mine = each.join(shared, "key").groupBy("sid", "n").agg(order.alias("keys"))
    left = _prefix(F.col("n")) - (F.col("n") - F.size("keys"))  # what the set has alone comes first
    return mine.filter(left > 0).select("sid", "n", F.explode(F.slice("keys.key", F.lit(1), left.cast("int"))).alias("key"))


def _close(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def _grouped(edges: DataFrame) -> DataFrame:
    """components of the edges; up to FEW are one task, which spares the rounds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory()
        pairs = np.concatenate([np.empty((0, 2), np.int64), *(f[["u", "v"]].to_numpy(np.int64) for f in frames)])
        nodes, at = np.unique(pairs, return_inverse=True)
        yield pd.DataFrame({"node": nodes, "root": nodes[roots(len(nodes), *at.reshape(-1, 2).T)]})

    e = written(edges.select("u", "v").filter("u != v"), "links")
    return e.coalesce(1).mapInPandas(run, "node long, root long") if e.count() <= FEW else components(e)


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.fromiter(map(len, values), np.int64, len(values))


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """The counts of sketches in width buckets; those of sketches twice as wide are summed."""
    out, lengths = np.empty((len(sketches), width), np.int16), _lengths(sketches)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at] = np.frombuffer(b"".join(sketches[at]), np.uint8).reshape(len(at), -1, width).sum(axis=1, dtype=np.int16)
    return out


def _sketched(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) without those that differ too much already by their sketches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = f["su"].to_numpy(), f["sv"].to_numpy()
                width, apart = np.minimum(_lengths(a), _lengths(b)), np.empty(len(f), np.int64)
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    for k in range(0, len(at), step := max(1, (1 << 21) // w)):
                        some = at[k : k + step]
                        apart[some] = np.abs(_folded(a[some], w) - _folded(b[some], w)).sum(axis=1, dtype=np.int64)
                yield f.loc[apart * (NUM + DEN) <= (f["nu"] + f["nv"]).to_numpy() * (DEN - NUM), ["u", "v"]]

    u, v = (held.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
    return pairs.join(v, "v").join(u, "u").mapInPandas(run, "u long, v long")


def _whole(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of the pairs (u, v), those whose whole sets are similar enough."""
    u, v = (held.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}")) for x in "uv")
    both = pairs.join(v, "v").join(u, "u")
    return written(both.filter(similar(F.size(F.array_intersect("hu", "hv")), F.col("nu"), F.col("nv"))).select("u", "v"), "similar")


def _checked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    return _whole(written(_sketched(pairs, held), "pairs"), held)


def _apart(sids: np.ndarray, ns: np.ndarray, labels: np.ndarray, sides: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the pairs of one key's sets that have different labels and sides and could be similar by their sizes and sketches."""
    widths, tree = _lengths(sketches), np.arange(len(sids))
    for w in np.unique(widths):  # sets of similar sizes have sketches of one width, or of one and its double
        at = np.flatnonzero((widths == w) | (widths == 2 * w))
        counts, wide = _folded(sketches[at], w), widths[at] > w
        for k in np.flatnonzero(~wide):
            i = at[k]
            n, m = ns[i], ns[at]
            q = np.flatnonzero((tree[at] != tree[i]) & (labels[at] != labels[i]) & (sides[at] != sides[i]) & (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (wide | (at > i)))
            if len(q):
                differ = np.abs(counts[q] - counts[k]).sum(axis=1, dtype=np.int64)
                j = at[q[differ * (NUM + DEN) <= (n + m[q]) * (DEN - NUM)]]
                if len(j):
                    j = _joined(tree, i, j)
                    yield np.minimum(sids[i], sids[j]), np.maximum(sids[i], sids[j])


def _joined(tree: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """One of places j of each tree, all of which become one with the tree of place i."""
    trees, first = np.unique(tree[j], return_index=True)
    tree[np.isin(tree, trees)] = tree[i]
    return j[first]


def _alike(sids: np.ndarray, ns: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: np.ndarray, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sets of different labels and sides that are similar, or a spanning forest of them and the labels."""
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, tree = np.r_[0, np.cumsum(ns)[:-1]], np.unique(labels, return_inverse=True)[1]
    mine = np.zeros(len(place), bool)
    for i in range(len(sids) - 1):
        n, m = ns[i], ns[i + 1 :]
        q = np.flatnonzero((tree[i + 1 :] != tree[i]) & (sides[i + 1 :] != sides[i]) & (n * DEN >= m * NUM) & (m * DEN >= n * NUM))
        if len(q):
            mine[own := place[starts[i] : starts[i] + n]] = True
            common = np.add.reduceat(mine[place[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)[q]
            mine[own] = False
            j = i + 1 + q[common * (NUM + DEN) >= (n + m[q]) * NUM]
            if len(j):
                j = _joined(tree, i, j) if forest else j
                yield np.minimum(sids[i], sids[j]), np.maximum(sids[i], sids[j])


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by key, c and d, with the starts and ends of their groups; a group may go on in the next frame."""
    held: list[pd.DataFrame] = []
    for f in chain(frames, [None]):
        held += [] if f is None or not len(f) else [f]
        last = held[-1] if held else None
        if last is None or f is not None and (last[["key", "c", "d"]].to_numpy(np.int64)[-1] == held[0][["key", "c", "d"]].to_numpy(np.int64)[0]).all():
            continue  # all of one group, which may go on
        now = pd.concat(held, ignore_index=True)
        at = now[["key", "c", "d"]].to_numpy(np.int64)
        starts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1]
        ends = np.r_[starts[1:], len(now)] if f is None else starts[1:]  # the last group may not be whole
        held = [] if f is None else [now.iloc[starts[-1] :]]
        yield now, starts[: len(ends)], ends


def _compared(frames: Iterator[pd.DataFrame], forest: bool = True) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, c and d -> pairs (u, v) of each such group, by sketches or, where there are any, by whole sets."""
    memory()
    for now, starts, ends in _cells(frames):
        sids, ns, labels, sides = (now[c].to_numpy(np.int64) for c in ("sid", "n", "label", "at"))
        sides = np.where(now["c"] == now["d"], sids, sides)  # of two chunks only the pairs across
        if "h" in now:
            sets = now["h"].to_numpy()
            found = [p for a, b in zip(starts, ends) if b > a + 1 for p in _alike(sids[a:b], ns[a:b], labels[a:b], sides[a:b], sets[a:b], forest)]
        else:
            sketches = now["sketch"].to_numpy()
            found = [p for a, b in zip(starts, ends) if b > a + 1 for p in _apart(sids[a:b], ns[a:b], labels[a:b], sides[a:b], sketches[a:b])]
        if found:
            yield pd.DataFrame({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])}).drop_duplicates()


def _dealt(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of keys (key, sid, n, label, chunks) with their sets, in groups of two chunks (c, d)."""
    met = members.withColumn("at", F.pmod(F.xxhash64("sid", F.lit(9)), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = met.select("key", F.least("at", "other").alias("c"), F.greatest("at", "other").alias("d"), "sid", "n", "label", "at").join(sets, "sid")
    return rows.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d").select("key", "c", "d", "sid", "n", "label", "at", *[c for c in sets.columns if c != "sid"])


def _could(labelled: DataFrame, held: DataFrame) -> DataFrame:
    """u, v: forests whose components hold all sets that meet at a key (key, sid, n, label), have different labels and could be similar."""
    same = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"x{k}") for k in (5, 6)]
    many = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("c"), *same).filter("least < most")
    once = many.groupBy("c", "x5", "x6").agg(F.min("key").alias("key"))  # of keys with the same members one
    still = _light(written(once.select("key", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks")), "still"))
    sketches = _light(written(held.select("sid", "sketch"), "sketches"))
    return _dealt(labelled.select("key", "sid", "n", "label").join(still, "key"), sketches).mapInPandas(_compared, "u long, v long").distinct()


def _rest(labelled: DataFrame, held: DataFrame, forest: bool = False) -> DataFrame:
    """u, v: the pairs of sets that meet at a key (key, sid, n, label), have different labels and are similar; or forests that connect the same labels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _compared(frames, forest)

    near = _light(written(_grouped(_could(labelled, held)), "near"))
    members = written(labelled.join(near, labelled["sid"] == near["node"]).select(F.col("root").alias("key"), "sid", "n", "label").distinct(), "members")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / WEIGHT)).cast("int")
    sized = _light(written(members.groupBy("key").agg(chunks.alias("chunks")), "sized"))
    return _dealt(_light(members).join(sized, "key"), held.select("sid", "h")).mapInPandas(run, "u long, v long").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """sid, rep (of the row of least id), root of every distinct set; one root is one group."""
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    with scratch(docs.sparkSession):
        found = written(_profiles(docs, shingle), "profiles")
        distinct = written(found.groupBy("sid").agg(F.min(rep).alias("rep"), F.first("n").alias("n")), "distinct", keep=True)
        staying = written(_staying(found, distinct), "staying")
        rows = _light(written(staying.select("rep.k1", "rep.k2"), "rows"))
        held = written(_sets(spread(_keyed(docs).join(rows, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])), shingle), "held", keep=True)
    keyed = written(_keys(held), "keyed")

    # sets of one fingerprint, and of linked ones
    sets = written(held.join(keyed.select("sid").distinct(), "sid", "left_semi").select("sid", "n", "fp"), "sets")
    heads = written(sets.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("head")), "heads")
    same = sets.join(heads, "fp").filter((F.col("sid") != F.col("head.sid")) & _close(F.col("n"), F.col("head.n"))).select(F.col("head.sid").alias("u"), F.col("sid").alias("v"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "uv")
    near = links(heads.select("fp")).join(a, "u").join(b, "v").filter(_close(F.col("hu.n"), F.col("hv.n"))).select(F.col("hu.sid").alias("u"), F.col("hv.sid").alias("v"))
    edges = _checked(same.unionByName(near), held)
    named = written(_grouped(edges), "components")

    # the shingles at which sets that are still apart meet
    labels = keyed.join(named, keyed["sid"] == named["node"], "left").select("sid", "n", "key", F.coalesce("root", "sid").alias("label"))
    mixed = written(labels.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("others")).filter("least < most").select("key", "others"), "mixed")
    met = written(labels.join(_light(mixed), "key"), "met")
    central = met.groupBy("sid").agg(F.sum("others").alias("central"))
    met = written(met.drop("others").join(central, "sid"), "met")

    labelled = met
    for by in (F.col("central"), F.xxhash64("sid", F.lit(3))):
        leads = labelled.groupBy("key").agg(F.max(F.struct(by.alias("by"), "sid", "n", "label")).alias("head"))
        apart = labelled.join(written(leads, "leads"), "key").filter((F.col("label") != F.col("head.label")) & _close(F.col("n"), F.col("head.n")))
        edges = edges.unionByName(_checked(apart.select(F.col("head.sid").alias("u"), F.col("sid").alias("v")).distinct(), held))
        named = written(_grouped(edges), "components")
        labelled = written(met.drop("label").join(named, met["sid"] == named["node"], "left").select("key", "sid", "n", "central", F.coalesce("root", "sid").alias("label")), "labelled")

    edges = edges.unionByName(written(_rest(labelled, held, forest=True), "rest"))
    named = written(_grouped(edges), "components")
    return distinct.join(named, distinct["sid"] == named["node"], "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group: the one of the least id."""
    with scratch(docs.sparkSession):
        heads = groups(docs, shingle).groupBy("root").agg(F.min("rep").alias("rep"))
        kept = written(heads.select(F.col("rep.k1").alias("r1"), F.col("rep.k2").alias("r2")), "kept", keep=True)
    a, b = fresh(docs, "k1", "k2")
    keyed = docs.select("*", *[k.alias(x) for k, x in zip(row_keys(), (a, b), strict=True)])
    return keyed.join(kept, (keyed[a] == kept["r1"]) & (keyed[b] == kept["r2"]), "left_semi").dropDuplicates([a, b]).drop(a, b)
