"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe, langid, lm, neardup, packing, pii, quality, simhash, substring, topk, urls  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97}x{i % 13}." for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(50))
TEXTS = [None, "", " \n\t", "Héllo World.", "Héllo World.", LONG, f"before one {PASSAGE} after", f"{PASSAGE} elsewhere now", "a " * 80, "the cat sat on the mat, and the cat sat still. " * 8, "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, 1), (3, "Héllo World.", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")


def words(t):
    return WORDS.findall(t or "")


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    packed = packing.pack_documents(docs, path).toPandas()
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue  # repeated below
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        mine = packed[packed.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert b"".join(mine.ids) == np.asarray(ids, "<u4").tobytes()
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in mine.itertuples())
    assert (packed.doc_id == 3).sum() == 2
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    assert packed.sequence_id.nunique() == math.ceil(packed.length.sum() / 2048)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_sweep_matches_successors():
    out = packing.sweep([("g", 10, 0, 2), ("g", 6, 5, 1), ("d", 6, 0, 1), ("d", 5, 0, 3)])
    matches = sorted(x[1:] for x in out if x[0] == "m")
    assert (6, 0, 1, 5, 6) in matches and sum(m[2] for m in matches if m[0] == 5) == 3


def test_topk(spark):
    rng = np.random.default_rng(0)
    vecs = rng.integers(-9, 9, (300, 8)).astype(float)
    vecs[50:120] = vecs[50]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 20 == 0, k=5, block=32).collect()
    for q in range(0, 300, 20):
        want = sorted((-int(vecs[q] @ vecs[i]), i) for i in range(300) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, vector array<double>"), F.lit(True)).count() == 0


def test_simhash(docs):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {}
    for i, t in enumerate(TEXTS):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [simhash.xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for i, fp in fps.items():
        group = {i}
        while more := {j for j in fps for k in group if (fps[j] ^ fps[k]).bit_count() <= 4} - group:
            group |= more
        assert got[i, simhash._signed(fp)] == min(group)


def test_components_of_hot_clusters(spark):
    rng = np.random.default_rng(1)
    fps = [int(rng.integers(0, 2**63))]
    for _ in range(300):
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        fps.append(x)
    v = np.unique(np.array(fps + [int(x) for x in rng.integers(0, 2**63, 300)], np.uint64))
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))
    root = simhash.roots(len(v), a, b)
    want = Counter(Counter(root.tolist()).values())
    df = spark.createDataFrame([(x,) for x in v.view(np.int64).tolist()], "fp long")
    got = Counter(Counter(r.root for r in simhash.components(simhash.links(df, hot=32)).collect()).values())
    assert got == Counter({n: c for n, c in want.items() if n > 1})


def similar_groups(texts):
    """texts: {id: text} -> {id: least id of its group}, by comparing all sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(texts)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def near_copies():
    """Copies with one to seven words changed (Jaccard about 0.98 to 0.7), a common passage, chains, copies, short texts."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common, texts = fresh(60), [None, "", "Same few", "same  few", "one two three four five six"]
    for _ in range(12):
        base = fresh(200) + common
        texts.append(" ".join(base))
        for changes in range(1, 8):
            w = list(base)
            for k in np.linspace(8, 190, changes).astype(int):
                w[k] = "changed"
            texts.append(" ".join(w))
    base = fresh(150)
    for k in range(60):  # one large group
        w = list(base)
        w[rng.integers(0, 150)] = f"edit{k}"
        texts.append(" ".join(w))
    return dict(enumerate(texts))


def test_neardup(spark):
    texts = near_copies()
    want = similar_groups(texts)
    assert 15 < len(set(want.values())) < len(texts) - 100
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(3, "same  few", "x")], "doc_id long, text string, extra string")
    for frequent in (neardup.FREQUENT, 10**9):
        neardup.FREQUENT, before = frequent, neardup.FREQUENT
        got = neardup.dedup(df)
        neardup.FREQUENT = before
        assert got.columns == df.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert neardup.dedup(df.limit(0)).count() == 0


def test_neardup_meets_few(spark):
    """Texts without a near copy go before any key is dealt, and a group whose members are just not similar is not paired out."""
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in range(300)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 200)) for _ in range(300)]
    for _ in range(150):
        words = list(base)
        for at in rng.choice(58, rng.integers(5, 8), replace=False) * 5:
            words[at] = f"c{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = neardup._profiles(df, 5)
    distinct = found.groupBy("sid").agg(F.first("n").alias("n"), F.first("doc_id").alias("rep"))
    stay = {r.rep for r in neardup._staying(found, distinct).collect()}
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    similar = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    pairs = {(i, j) for i in range(300, 450) for j in range(i + 1, 450) if similar(sets[i], sets[j])}
    assert 0 < len(pairs) < 2_000 and {x for p in pairs for x in p} <= stay and not any(i < 200 for i in stay)

    held = neardup._sets(df, 5).cache()
    labelled = neardup._keys(held).withColumn("label", F.col("sid")).cache()
    ids = {neardup._sid(neardup.shingles(t)): i for i, t in enumerate(texts)}
    neardup.CHUNK, before = 16, neardup.CHUNK
    met = {tuple(sorted((ids[r.u], ids[r.v]))) for r in neardup._rest(labelled, held).collect()}
    neardup.CHUNK = before
    assert pairs <= met and len(met) < 150 * 149 / 4


def test_neardup_forests():
    """A key and a component return fewer pairs than they have sets, whatever links: by sketches of any width, in one frame or several."""
    rng = np.random.default_rng(9)
    bases = [rng.integers(-(2**62), 2**62, n) for n in (300, 2_200, 1_500)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) > share], rng.integers(-(2**62), 2**62, 3)]) for b in (*bases, bases[1][:2_000]) for share in [0.01] * 10 + [0.1] * 20]
    f = pd.DataFrame({"key": 7, "c": 0, "d": 0, "sid": range(len(sets)), "n": [len(x) for x in sets], "label": range(len(sets)), "at": 0})
    f["sketch"] = [np.minimum(np.bincount(x & 255, minlength=256), 255).astype(np.uint8).tobytes() for x in sets]
    n, common = f["n"].to_numpy(), np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    alike = np.triu(9 * common >= 4 * (n[:, None] + n[None, :]), 1)
    want = simhash.roots(len(sets), *np.nonzero(alike))
    assert alike.sum() > 10 * len(sets) and len(set(want)) < len(sets)

    def links(f, *forest):
        out = pd.concat(neardup._compared(iter([f[:50], f[50:51], f[:0], f[51:]]), *forest))
        return out["u"].to_numpy(), out["v"].to_numpy()

    u, _ = links(f)
    assert len(u) < len(sets)
    f["sketch"] = [neardup.sketch_of(x) for x in sets]
    assert len(set(f["sketch"].str.len())) > 2
    u, v = links(f)
    could = simhash.roots(len(sets), u, v)
    assert len(u) < len(sets) and all(could[a] == could[b] for a, b in np.argwhere(alike))
    f["h"] = sets
    u, v = links(f)
    assert len(u) < len(sets) and (simhash.roots(len(sets), u, v) == want).all()
    u, v = links(f, False)
    assert {*zip(u, v, strict=True)} == {tuple(x) for x in np.argwhere(alike)}
    f["label"] = want  # connected before
    assert not list(neardup._compared(iter([f])))


def test_neardup_components(spark):
    """Few links are grouped by one task, and as the rounds group many."""
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, 300)[rng.integers(0, 300, (170, 2))]] + [(k, k + 1) for k in range(500)] + [(5, 5), (900, 900)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    got = []
    for few in (10**6, 0):
        with mock.patch.object(neardup, "FEW", few):
            got.append(sorted(map(tuple, neardup._grouped(edges).collect())))
            assert neardup._grouped(edges.limit(0)).count() == 0
    assert got[0] == got[1] and (500, 0) in got[0] and len(dict(got[0])) == len(got[0])


def test_neardup_rest(spark):
    """Sets still apart at a key, in several cliques and by near misses, become the components of all their links, whatever the chunks."""
    rng = np.random.default_rng(10)
    texts = []
    for size, many in ((300, 40), (1_500, 12)):
        base = [f"b{size}x{x}" for x in range(size)]
        for clique in range(3):
            head = [f"q{clique}x{x}" if size * 0.8 < x < size * 0.88 else w for x, w in enumerate(base)]
            for _ in range(many):
                words = list(head)
                for at in rng.choice(size // 5, size // 100 * (1 + 2 * (rng.random() < 0.3)), replace=False) * 5:
                    words[at] = f"c{rng.integers(0, 10**9)}"
                texts.append(" ".join(words))
    sets = [neardup.shingles(t) for t in texts]
    n = np.array([len(x) for x in sets])
    common = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    alike = np.triu(9 * common >= 4 * (n[:, None] + n[None, :]), 1)
    want = simhash.roots(len(sets), *np.nonzero(alike))
    assert alike.sum() > 5 * len(sets) and 2 < len(set(want)) < len(sets) - 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held = neardup._sets(df, 5).cache()
    labelled = neardup._keys(held).withColumn("label", F.col("sid")).cache()
    ids = {neardup._sid(x): i for i, x in enumerate(sets)}
    for chunk, weight in ((neardup.CHUNK, neardup.WEIGHT), (16, 1 << 20), (512, 10_000)):
        with mock.patch.multiple(neardup, CHUNK=chunk, WEIGHT=weight):
            every = {tuple(sorted((ids[r.u], ids[r.v]))) for r in neardup._rest(labelled, held).collect()}
            rows = neardup._rest(labelled, held, forest=True).collect()
        assert every == {tuple(x) for x in np.argwhere(alike).tolist()}
        assert (simhash.roots(len(sets), np.array([ids[r.u] for r in rows]), np.array([ids[r.v] for r in rows])) == want).all()
        assert chunk == 16 or weight == 10_000 or len(rows) < len(sets)
    kept = sorted(r.doc_id for r in neardup.dedup(df).collect())
    assert kept == sorted(set(want.tolist()))


def test_langid(spark):
    en, de = "the house and the garden are with that thing ", "das haus und der garten sind mit dem ding "
    rows = [(i, (en, de)[i % 2] * 3, ("en", "de")[i % 2]) for i in range(30)] + [(98, None, "en"), (99, "1234 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = langid.pieces_of(P.path("piece_bpe_32k.model"))
    languages, p = langid.train(df.filter("doc_id < 20"), pieces)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.drop("lang"), pieces, languages, p).collect()}
    assert all(got[i][0] == ("en", "de")[i % 2] and 0 <= got[i][1] <= 1 for i in range(30))
    assert got[98] == got[99] == ("und", 0.0)
    # the forward sum over a word equals the sum over its segmentations
    cut, prob = langid.Segmenter(["▁", "a", "b", "ab", "▁a"]), np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    alpha = langid.forward(cut.spans(["ab"]), 3, prob)[3][0, 0]
    assert alpha == pytest.approx(0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3)
    assert langid.train(df.limit(0), pieces)[0] == []


def test_pii(spark):
    text = "Card 4111 1111 1111 1111, not 4111 1111 1111 1112; +1 (743) 555-3824, 10.0.0.1, 300.1.1.1, 123-45-6789, 1985-02-28, 1985-02-31, a.b@c.de, DE89 3704 0044 0532 0130 00."
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "clean 12 text."), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    new = got[1].text
    assert new == got[2].text and got[3].text is None and got[4].text == "clean 12 text." and got[5].text == ""
    for gone in ("4111 1111 1111 1111", "555-3824", "10.0.0.1", "123-45-6789", "1985-02-28", "a.b@c.de", "DE89"):
        assert gone not in new.replace("4111 1111 1111 1112", "")
    for kept in ("4111 1111 1111 1112", "1985-02-31", "300.1.1.1", "+1 ("):
        assert kept in new
    digits = [int(c) for c in re.search(r"Card ([\d ]+),", new)[1] if c.isdigit()]
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    assert pii.pseudonymise(df, "other").filter("doc_id = 1").first().text != new
    some = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert some.select(pii.permuted_digits(F.col("d"), "k", "t").alias("x")).distinct().count() == 10000


def test_pii_cards_beside_numbers(spark):
    card, other = "4111 1111 1111 1111", "5500005555555559"
    rows = [
        (f"{card} 12/27", 1), (f"12 {card}", 1), (f"7536784127813051 {other}", 1), (f"{card} {other}", 2), (f"1111 {card} 3", 1), ("12-3782-822463-10005 7", 1),
        (f"XX12 {card}", 1), (f"+1 743 555 3824 {card}", 1), (f"AB12 CDEF GHIJ KLMN OPQR {card}", 1), (f"{card} 1985-02-28 \ue000 10.0.0.1 {other}", 2),
        ("4111 1111 1111 1112 12/27", 0), ("1 2 3 4 " * 9000, 0), (f"4111111111111111 {card}", 2),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, (t, n) in enumerate(rows):
        new = got[i].text
        assert got[i].n_card == n and (new == t) == (n == 0) and (i == 9 or len(new) == len(t)), t
        assert not any(x in new for x in (card, "4111111111111111", other, "3782-822463-10005")), t
    assert got[0].text.endswith(" 12/27") and got[1].text.startswith("12 ") and got[0].text[:19] == got[1].text[3:] == got[3].text[:19]
    assert got[9].n_date == got[9].n_ip == 1 and "\ue000" in got[9].text and "10.0.0.1" not in got[9].text


def test_substring(docs):
    for hot in (1, 500):
        got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(docs, hot=hot, digest=True).collect()}
        rows = [words(t) for t in TEXTS]
        starts = Counter(tuple(w[k : k + 35]) for w in rows for k in range(len(w) - 34))
        for i, w in enumerate(rows):
            gone = {j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            assert got[i, len(w)] == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([("http://A.example.net/en/x?q",), ("http://a.net/",), ("http://b.org/fr/",), ("http://example.com/de/",), ("nothing",), (None,), ("http://evil.org:80/p/#x",)], "url string")
    listed = spark.createDataFrame([("https://www.evil.org/p",)], "url string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.RULES, listed).collect()}
    assert got["http://A.example.net/en/x?q"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got["http://a.net/"][2:] == ("net/", "block") and got["http://b.org/fr/"][2:] == ("org/fr/", "allow")
    assert got["http://example.com/de/"][2:] == ("example.com/de/", "block")
    assert got["nothing"] == got[None] == ("", "", None, "allow") and got["http://evil.org:80/p/#x"][3] == "block"


def test_bpe(docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, path, P.PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (t or "").encode()
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(out, path, P.PATTERN).collect()}[5] == LONG.encode()


@pytest.mark.parametrize("order,block,part", [(2, 5000, 2000), (3, 5000, 2000), (3, 10**7, 10**7), (4, 500, 300)])
def test_lm(spark, order, block, part):
    """Against the smoothed probabilities worked out by recursion; ids beside nulls stay whole."""
    rng = np.random.default_rng(0)
    few = ["the", "cat", "Sat", "on", "mat", "Ünï"]
    texts = [*TEXTS, *[" ".join(rng.choice(few, rng.integers(1, 30))) for _ in range(30)], " ".join(rng.choice(few, 1500))]
    texts += texts[20:22] * 2
    rows = [(i + 2**60 + 1, t, "x", 1) for i, t in enumerate(texts)] + [(None, "the cat", "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, block int").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 3 == 1, order, block, part).collect()}
    assert set(got) == {r[0] for r in rows}
    toks = {i: (t or "").translate(LOWER).split() + ["</s>"] for i, t, *_ in rows}
    train = [w for i, w in toks.items() if i is None or i % 3 != 1]
    c: Counter = Counter({("<s>",): len(train)})
    for w in train:
        c.update((x,) for x in w)
        for k in range(2, order + 1):
            c.update(zip(*[["<s>", *w][j:] for j in range(k)], strict=False))
    n, v = sum(map(len, train)), len({x for w in train for x in w})

    def p(history, x):
        if not history:
            return (c[(x,)] + 0.5) / (n + 0.5 * (v + 1))
        return (c[(*history, x)] + lm.MASS * p(history[1:], x)) / (c[history] + lm.MASS)

    for i, w in toks.items():
        whole, r = ["<s>", *w], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[(x,)] > 0 for x in w), n, i is not None and i % 3 == 1)
        assert r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(whole[max(0, k - order + 1) : k]), whole[k])) for k in range(1, len(whole))))


def test_lm_states(spark):
    """Each state's probabilities sum to one over all tokens and the unknown one, arcs and failure arcs taken as they lie."""
    rows = [(b"a b a c", False), (b"b a b", False), (b"zz a", True)]
    frame = pd.DataFrame({"id": list("012"), "text": [t.decode() for t, _ in rows], "held_out": [h for _, h in rows]})
    with mock.patch.object(lm, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        docs = next(lm._cut(10**6)(iter([frame])))
    known = next(lm._ask_words(1)(iter([docs])))
    answers, parts = lm._answer_words(1)(known), {1: 1}
    for level in (2, 3):
        asked = lm._ask_grams(level, 3, dict(parts), 1, 2)(docs, answers)
        answers = pd.concat([answers, lm._answer_grams(level, level == 3)(asked)])
        parts[level] = 1
    block = lm._informed(docs, answers, 3, parts, 2)
    auto = lm.Automaton(block, 9, 4, 2, 2.0)
    at = {(int(h), int(w)): g for g, (h, w) in enumerate(zip(block.history[2], block.word[2], strict=True))}
    known_words = np.flatnonzero(block.count[1] > 0)
    unknown = 0.5 / (9 + 0.5 * 5)
    for h in [*np.flatnonzero((block.count[1] > 0) & (np.arange(block.vocabulary) > 0)), block.vocabulary]:
        state, total = 1 + h, 0.0
        for w in known_words:
            g = at.get((h, w))
            total += 10 ** auto.weight[2][g] if g is not None and auto.has[2][g] else 10 ** (auto.fail[state] + auto.weight[1][w])
        assert total + 10 ** auto.fail[state] * unknown == pytest.approx(1)
    real = auto.level > 0  # grams that training lacks are no states
    assert (auto.level[auto.shorter[real]] < auto.level[real]).all() and (auto.fail[real] < 0).all()
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality(docs.filter("doc_id <> 3")).collect()}
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        w = words(t)
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)})
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), rep, sum(map(len, w)))
        assert got[i].base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (got[i].kept and got[i].base_failed)
    assert got[6].kept or got[6].lost_percent > 50
    assert quality.quality(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = d
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, kept, "").cache()
        assert after.columns == d.columns and 0 < after.count() <= kept.count(), name
        kept = after
    packed = C.STAGES[-1][1](spark, kept, "")
    assert packed.select("doc_id").distinct().count() == kept.count()
