"""Packing, propagation, scores and inference against versions by plain loops."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
import xxhash

from plumbline.llm import common, langid, ngrams, packing, sharding, toxicity


def plain_best_two_fit(lengths, most):
    """Bins as lists of lengths, by lists."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], most
        while (x := next((v for v in left if v <= gap), None)) is not None:
            left.remove(x)
            held.append(x)
            gap -= x
        if gap and len(held) > 1:
            room, best = gap + held[-1], (held[-1], None)
            for a in sorted({v for v in left if v < room}):
                others = list(left)
                others.remove(a)
                b = next((v for v in others if v <= room - a), None)
                if b is not None and a + b > best[0]:
                    best = (a + b, (a, b))
            if best[1]:
                for v in best[1]:
                    left.remove(v)
                left = sorted([*left, held[-1]], reverse=True)
                held[-1:] = best[1]
        bins.append(held)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    r = random.Random(seed)
    most = r.choice([20, 64, 100])
    lengths = np.array([min(most, max(1, int(r.expovariate(3 / most)))) for _ in range(r.choice([1, 40, 300]))])
    bins, offsets = packing.best_two_fit(lengths, most)
    got = [[int(lengths[i]) for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i])] for b in range(bins.max() + 1)]
    assert got == plain_best_two_fit(lengths.tolist(), most)


def spark_hash(value, number):
    """xxhash64 of a long, then an int."""
    h = xxhash.xxh64(struct.pack("<i", number), seed=xxhash.xxh64(struct.pack("<q", value), seed=42).intdigest()).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_propagation(nodes, n, shards):
    """nodes: (link, shard) by number -> the same after all turns."""
    quota, held = n // shards, {}
    for link, shard in nodes.values():
        if link is not None:
            held.setdefault(link, {}).setdefault(shard, 0)
            held[link][shard] += 1
    goes = {link: next(iter(h)) for link, h in held.items() if len(h) == 1}
    room = [max(0, quota - sum(sum(held[x].values()) for x, s in goes.items() if s == j)) for j in range(shards)]
    waiting = [x for x in held if x not in goes]
    for turn in range(shards):
        asks = {}
        for x in waiting:
            k = sum(held[x].values())
            if k <= max(room):
                best = max((held[x].get(j, 0), room[j], spark_hash(x, j), j) for j in range(shards) if room[j] >= k)
                asks.setdefault((best[3], k), []).append(x)
        if not asks:
            break
        waiting = [x for some in asks.values() for x in some]
        for (j, k), some in sorted(asks.items(), key=lambda a: (a[0][0], -a[0][1])):
            some.sort(key=lambda x: (spark_hash(x, turn) % (1 << 64)) >> 11)
            let_in = some[: room[j] // k]
            room[j] -= k * len(let_in)
            goes |= dict.fromkeys(let_in, j)
        waiting = [x for x in waiting if x not in goes]
    return {i: (link, goes[link]) if link in goes else (None, shard) for i, (link, shard) in nodes.items()}


@pytest.mark.parametrize("seed", range(3))
def test_propagation(spark, seed):
    r = random.Random(seed)
    shards, links = r.choice([3, 5, 8]), [r.getrandbits(62) for _ in range(60)]
    sizes = [r.choice([2, 3, 3, 4, 9, 25]) for _ in links]
    rows = [(x, r.randrange(shards)) for x, k in zip(links, sizes, strict=True) for _ in range(k)] + [(None, r.randrange(shards)) for _ in range(r.choice([0, 200]))]
    nodes = dict(enumerate(rows))
    df = spark.createDataFrame([(i, 1, 0, x, False, s) for i, (x, s) in nodes.items()], "doc_id long, size long, text_crc32 long, link long, wide boolean, shard int")
    got = {x.doc_id: (x.link, x.shard) for x in sharding.propagate(df, len(nodes), shards, common.Scratch(spark, "t")).collect()}
    want = plain_propagation(nodes, len(nodes), shards)
    assert got == want
    split = lambda state: sum(len({s for _, s in some}) > 1 for some in itertools.groupby(sorted((x, state[i][1]) for i, (x, _) in nodes.items() if x is not None), key=lambda e: e[0]) for some in [list(some[1])])
    assert split(got) < split(nodes) / 2


def plain_grams(text, sizes):
    """All character n-grams of folded text, each hashed on its own by whole numbers."""
    folded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    out = []
    for n in sizes if folded.strip() else ():
        for i in range(len(folded) - n + 1):
            m = (1 << 32) - 1
            points = [ord(c) for c in folded[i : i + n]]
            h = points[0] * 0x9E3779B1 & m
            for p in points[1:]:
                h ^= h >> 15
                h = (h + p) * 0x85EBCA6B & m
            h ^= h >> 13
            h = h * 0xC2B2AE35 & m
            out.append(h ^ h >> 16 ^ (n * 0x27D4EB2F & m))
    return out


TEXTS = ["", "Ein kleiner Satz, mit Zeichen!", "aa  bb--cc", "1234 ..", "Mixed ÄÖ text 日本 here", "a"]


@pytest.mark.parametrize("text", TEXTS)
def test_grams(text):
    points = ngrams.folded(text)
    got = [int(h) for n in (3, 4, 5) for h in (ngrams.grams(points, n) if len(points) else ())]
    assert got == plain_grams(text, (3, 4, 5))


@pytest.mark.parametrize("text", TEXTS)
def test_toxicity_scores(text):
    r = random.Random(2)
    every = sorted({h for t in TEXTS for h in plain_grams(t, toxicity.SIZES)})
    chosen = sorted(r.sample(every, len(every) // 2))
    weights = {h: r.uniform(-1, 1) for h in chosen}
    model = toxicity.Model(np.array(chosen, np.uint32), np.array([weights[h] for h in chosen]), -0.7)
    z = -0.7 + sum(weights.get(h, 0) for h in set(plain_grams(text, toxicity.SIZES)))
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_log_count_ratios_and_training():
    with1, with0 = np.array([9.0, 1.0, 3.0]), np.array([1.0, 9.0, 3.0])
    ratio = toxicity.log_count_ratio(with1, with0)
    assert ratio == pytest.approx([math.log((a + 1) / 16) - math.log((b + 1) / 16) for a, b in zip(with1, with0, strict=True)])
    r = random.Random(1)
    rows = [np.array(sorted({i for i in range(3) if r.random() < (0.6, 0.2, 0.4)[i if y else (1, 0, 2)[i]]}), np.int32) for y in (0, 1) for _ in range(80)]
    y = np.repeat([0.0, 1.0], 80)
    w, b = toxicity._train(rows, y, ratio, 0.0, ridge=1.0)
    x = np.zeros((160, 3))
    for i, at in enumerate(rows):
        x[i, at] = ratio[at]
    p = 1 / (1 + np.exp(-(b + x @ w)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05  # where the ridge's loss is flat


def penalised(model, some, at, n, penalty=3.0):
    cost = penalty * math.log(max(2, n.sum())) / 2 + 1
    w = [1 / len(some)] * len(some)
    p = [[math.exp(model.log_p[k, g]) for g in at] for k in some]
    for _ in range(200):
        new = [0.0] * len(some)
        for g, c in enumerate(n):
            whole = sum(w[k] * p[k][g] for k in range(len(some)))
            for k in range(len(some)):
                new[k] += c * w[k] * p[k][g] / whole
        w = [v / n.sum() for v in new]
    return sum(c * math.log(sum(w[k] * p[k][g] for k in range(len(some)))) for g, c in enumerate(n)) - cost * (len(some) - 1), w


def test_languages_of_a_text_against_all_sets():
    r = np.random.default_rng(3)
    log_p = np.log(r.dirichlet(np.full(60, 0.3), 4) * 0.98 + 0.02 / 60)
    model = langid.Model(["a", "b", "c", "d"], log_p)
    for truth in ([1.0, 0, 0, 0], [0.5, 0.5, 0, 0], [0, 0.3, 0, 0.7], [0.4, 0.3, 0.3, 0], [0, 0, 1.0, 0]):
        counts = r.multinomial(400, np.array(truth) @ np.exp(log_p))
        at = np.flatnonzero(counts)
        got = langid.infer(model, at, counts[at])
        best = max((penalised(model, some, at, counts[at]) + (some,) for k in range(1, 5) for some in itertools.combinations(range(4), k)), key=lambda x: x[0])
        want = {model.languages[k]: w for k, w in zip(best[2], best[1], strict=True)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.03 for k in got)
        assert list(got) == sorted(got, key=lambda k: -got[k])


def test_rows_without_a_number_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id long").select("doc_id", langid.held_out("doc_id").alias("h")).collect()
    import zlib

    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert rows[0].h is False


def test_word_hashes():
    text = "The the  THE\tx\n\x0bé É日本 \x85\u00a0 a\x1cb" + " lo" * 40
    for t in (text, "", None, "   ", "one"):
        names = common.words(t)
        got = common.word_hashes(t)
        assert len(got) == len(names) and len({*zip(names, got.tolist(), strict=True)}) == len(set(names)) == len(set(got.tolist()))
