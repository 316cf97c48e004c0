"""Operators against plain versions of what they compute, and learned ones on rows held out."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, components, langid, minhash, mixing, mtree, packing, quality, sharding, spans, toxicity


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def more(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    u = Union(range(600))
    for a, b in edges:
        u.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()
    assert {x.node for x in got} == {i for a, b in edges if a != b for i in (a, b)}
    root = {x.node: x.root for x in got}
    assert len(root) == len(got)
    for a in root:
        assert u.find(a) == u.find(root[a])
    assert len(set(root.values())) == len({u.find(a) for a in root})


def test_ranks_without_a_global_window(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([0.1, 0.5, r.random()]), r.randrange(9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, id int, at double, w long")
    got = collections.defaultdict(list)
    for x in common.bucketed(df, ["k"], "at", len(rows), "w").collect():
        got[x.k].append((x["rank"], x.at, x.before, x.w))
    assert sum(map(len, got.values())) == len(rows)
    for xs in got.values():
        xs.sort()
        assert [x[0] for x in xs] == list(range(len(xs))) and [x[1] for x in xs] == sorted(x[1] for x in xs)
        total = 0
        for x in xs:
            assert x[2] == total
            total += x[3]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_groups(rows, k, percent=80):
    s = {d: shingles(t, k) for d, t in rows}
    u = Union(s)
    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and percent * max(len(s[a]), len(s[b])) <= 100 * min(len(s[a]), len(s[b])):
                n = len(s[a] & s[b])
                if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                    u.join(a, b)
    return {d: (len(s[d]), u.find(d), u.find(d) == d) for d in s}


def check_near(docs, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k).collect()}
    assert got == near_groups(rows, k)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    check_near(docs, k)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with more or fewer edits, chains of edits, and copies of copies: many lie near the threshold."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows, last = [], words
    for i in range(420):
        base = words if i % 3 else last
        copy = base[:]
        for _ in range(r.randrange(9)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(40)}"
        if i % 7 == 0:
            copy = copy[: r.randrange(90, 121)]
        last = copy
        rows.append((1000 - i, " ".join(copy)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4)


def test_bit_estimates():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = int(2 * share / (1 + share) * 1000)
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - both : 2000 - both])
        p = minhash.packed(minhash.minima([a, b])).view(np.uint64)
        x = p[0] ^ p[1]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ = int(np.bitwise_count(x & np.uint64(minhash._ONES)).sum())
        got = (1 - differ / minhash.PERMUTATIONS - 1 / 16) / (1 - 1 / 16)
        assert abs(got - both / (2000 - both)) < 0.2


def test_spans(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    first, held = {}, {}
    for d, t in rows:
        ends = spans.sentences(t)
        words = [tuple(t[a:b].lower().split()) for a, b in zip([0, *ends], ends)]
        size = [len(w) for w in words]
        assert ends[-1] == len(t) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
        found = set()
        for i in range(len(words)):
            j = i + 2
            while j <= len(words) and sum(size[i:j]) < 25:
                j += 1
            if j <= len(words):
                found.add((i, j))
            a, j = i - 1, i + 1
            while a >= 0 and sum(size[a:j]) < 25:
                a -= 1
            if a >= 0:
                found.add((a, j))
        held[d] = (ends, [(i, j, tuple(words[i:j])) for i, j in sorted(found)])
        for i, _, run in held[d][1]:
            first.setdefault(run, (d, i))
    want = {}
    for d, t in rows:
        ends, runs = held[d]
        gone = {s for i, j, run in runs if first[run] != (d, i) for s in range(i, j)}
        starts = [0, *ends]
        want[d] = ("".join(t[starts[s] : ends[s]] for s in range(len(ends)) if s not in gone), len(gone))
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeats(docs).collect()}
    assert got == want and any(n for _, n in want.values())


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing._path(None))
    odd = "Don't we've 'S ÄÖ Straße İ a b <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b 12.5% $$$ ---- ñ´` 😀 x\x1cy\x85z " + "q" * 300
    some = docs.limit(60).select("doc_id", "text").union(docs.sparkSession.createDataFrame([(-1, odd)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in some.collect()}
    got = {d: {} for d in text}
    for r in packing.pieces(some).collect():
        got[r.doc_id][r.piece] = (r.start, r.length, bytes(r.ids))
    for d, x in text.items():
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        assert got[d] == {i: (a, len(ids[a : a + 2048]), ids[a : a + 2048].tobytes()) for i, a in enumerate(range(0, len(ids), 2048))}
    for r in packing.pack(some).collect():
        assert r.ids_crc32 == zlib.crc32(got[r.doc_id][r.piece][2])


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    r = np.random.default_rng(seed)
    most = [8, 100, 2048][seed % 3]
    x = np.minimum(most, 1 + r.geometric(4 / most, 800))
    bins, offsets = packing.best_two_fit(x, most)
    fill = collections.defaultdict(list)
    for b, o, n in zip(bins, offsets, x, strict=True):
        fill[b].append((o, n))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    greedy = []
    for n in sorted(x, reverse=True):  # first fit, longest first
        i = next((i for i, f in enumerate(greedy) if f + n <= most), None)
        if i is None:
            greedy.append(n)
        else:
            greedy[i] += n
    assert len(fill) <= len(greedy) + 1 and len(fill) >= -(-x.sum() // most)


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        x = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if x[s] > most * sizes[s]}
        if not over:
            return got | x
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over


def test_targets(spark):
    r = random.Random(5)
    for _ in range(4):
        sizes = {s: r.choice([0, 1, 10, r.randrange(10_000)]) for s in ["b", "a", None, "é", "z", "Z"][: r.randrange(1, 7)]}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = level(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mixing(docs):
    d, draws = mixing.mix(docs, shard_words=3000, block_words=64)
    draws = draws.persist()
    size = {(r.key, r.dup): r["size"] for r in d.collect()}
    seen = set()
    for r in draws.collect():
        assert (r.key, r.dup, r.epoch, r.block) not in seen and 0 < r.words <= 64 and r.block * 64 + r.words <= size[r.key, r.dup]
        seen.add((r.key, r.dup, r.epoch, r.block))
    assert len({r.shard for r in draws.collect()}) > 5
    again = mixing.mix(docs.repartition(7), shard_words=3000, block_words=64)[1]
    assert again.exceptAll(draws).isEmpty() and draws.exceptAll(again).isEmpty()
    assert mixing.render("a  b c d\te f", [(0, 2), (1, 2), (2, 1)], 2) == "a  b c d\te"
    assert mixing.render("a  b c d\te f", [(1, 1)], 2) == "c"


def test_sharding(spark, docs):
    hot = docs.sparkSession.range(150).select((F.col("id") + 10_000).alias("doc_id"), F.lit("one text for all").alias("text"))
    pairs = docs.sparkSession.range(90).select((F.col("id") + 20_000).alias("doc_id"), F.concat(F.lit("pair "), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    rows = sharding.shard(docs.select("doc_id", "text").union(hot).union(pairs)).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 440
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text_crc32, r["size"]].add(r.shard)
    held = collections.Counter((r.text_crc32, r["size"]) for r in rows)
    cut = sum(len(where[g]) - 1 for g, n in held.items() if 1 < n < 20)
    assert cut <= 4


def brute(x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        out[q] = [(int(-a), int(i)) for a, i in sorted((-int(s[i]), i) for i in range(len(x)) if i != q)[:k]]
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 7)
    r = np.random.default_rng(1)
    x = {"clusters": r.normal(size=(8, 6))[r.integers(0, 8, 400)] + 0.05 * r.normal(size=(400, 6)), "noise": r.normal(size=(400, 6)), "ties": r.integers(-1, 2, (400, 3)).astype(float)}[kind]
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in mtree.top_k(v, F.col("vec_id") % 20 == 0, 9).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.score, row.vec_id))
    assert got == brute(np.floor(64 * x).astype(np.int64), range(0, 400, 20), 9)


def test_trees_prune(monkeypatch):
    """Pages hold what they say, answers are exact, and on clustered data most pages are never opened."""
    monkeypatch.setattr(mtree, "PAGE", 16)
    r = np.random.default_rng(2)
    x = np.floor(64 * (20 * r.normal(size=(12, 4))[np.arange(600) % 12] + 0.1 * r.normal(size=(600, 4))))
    space = mtree.Space(4, int((x * x).sum(1).max()), True)
    import pandas as pd

    pages = pd.DataFrame(mtree.build(np.arange(600), x, space))
    lifted = space.lift(x)
    for p in pages.itertuples():
        if p.ids:
            d = np.linalg.norm(lifted[np.frombuffer(p.ids, np.int64)] - np.frombuffer(p.pivot), axis=1)
            assert len(d) <= 16 and (d <= p.radius + 1e-9).all() and np.allclose(d, np.frombuffer(p.away))
    tree = mtree.Tree(pages, space)
    opened = []

    class Seen(list):
        def __getitem__(self, i):
            opened.append(i)
            return list.__getitem__(self, i)

    tree.vectors = Seen(tree.vectors)
    want = brute(x.astype(np.int64), range(0, 600, 30), 5)
    for q, best in want.items():
        ids, scores = tree.search(q, x[q], 5, -np.inf)
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == [(-s, i) for s, i in best]
    assert len(opened) < 0.5 * len(want) * (pages["ids"].str.len() > 0).sum()


def test_language(more):
    docs, _ = more
    model = langid.fit(docs)
    x = langid.identify(docs.where("crc32(cast(doc_id as string)) % 4 = 2"), model)
    n, right = x.count(), x.where("lang = lang_pred").count()
    assert n > 200 and right >= 0.97 * n
    en, fr = (docs.where(F.col("lang") == code).orderBy(F.desc("n_chars")).first().text[:3000] for code in ("en", "fr"))
    both = langid.identify(docs.sparkSession.createDataFrame([(f"{en} {fr}",)], "text string"), model).first().languages
    assert set(both) == {"en", "fr"} and all(abs(v - 0.5) < 0.25 for v in both.values())


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity(more):
    docs, labels = more
    out = toxicity.rate(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    en = [(r.score, r.toxic) for r in out if r.lang == "en"]
    assert auc(en) > 0.8
    quiet = [r for r in out if not r.toxic]
    assert sum(r.predicted for r in quiet) <= 0.05 * len(quiet)


def test_quality(more):
    docs, labels = more
    out = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert auc([(r.score, r.quality) for r in out]) > 0.95
    assert sum(r.kept == bool(r.quality) for r in out) >= 0.95 * len(out)


