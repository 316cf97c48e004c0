"""Posteriors of sites against plain sums, and words as evidence."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality


def flat(**weights):
    """A model whose evidence is a function of one feature alone: the log of the number of words."""
    n = len(quality.features(F.lit(""))) + 1
    w = np.zeros(n + 1)
    w[0], w[1] = weights["base"], weights["words"]
    return quality.Model(np.zeros(n), np.ones(n), w, np.zeros(quality.BUCKETS))


def strength(groups):
    """groups of (n, s, prior) -> how many documents a prior counts as."""
    some = [(n, s, p) for n, s, p in groups if n > 1]
    if not some:
        return 10.0
    spread = sum((s / n - p) ** 2 for n, s, p in some) / len(some)
    chance = sum(p * (1 - p) / n for n, s, p in some) / len(some)
    base = sum(p * (1 - p) for _, _, p in groups) / len(groups)
    return min(1e4, max(2.0, base / max(spread - chance, 1e-6) - 1))


def test_posteriors(spark):
    r = random.Random(4)
    places = ["http://a.org/x/y/z.html", "http://a.org/x/y/w.html", "http://a.org/u", "https://B.org/one?q=1", "plain", None, "s/t", "http://c.org/only/here"]
    lengths = {p: r.randint(1, 60) for p in places}
    rows = []
    for i in range(400):
        p = r.choice(places)
        rows.append((i, " ".join(["w"] * max(1, lengths[p] + r.randint(-5, 5))), p))
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), flat(base=-2.0, words=0.8)).collect()}
    site = {"http://a.org/x/y/z.html": ("a.org", "x/y"), "http://a.org/x/y/w.html": ("a.org", "x/y"), "http://a.org/u": ("a.org", "u"), "https://B.org/one?q=1": ("b.org", "one"), "plain": ("plain", ""), None: (None, ""), "s/t": ("s", "t"), "http://c.org/only/here": ("c.org", "only/here")}
    e = {i: 1 / (1 + math.exp(-(-2.0 + 0.8 * math.log1p(len(t.split()))))) for i, t, _ in rows}
    mean = sum(e.values()) / len(e)
    of = {i: site[p] for i, _, p in rows}
    add = lambda name: {k: (sum(of[i][: len(k)] == k for i in e), sum(e[i] for i in e if of[i][: len(k)] == k)) for k in {of[i][:name] for i in e}}
    hosts, paths = add(1), add(2)
    k = strength([(n, s, mean) for n, s in hosts.values()])
    mu = {h: (k * mean + s) / (k + n) for h, (n, s) in hosts.items()}
    j = strength([(n, s, mu[p[:1]]) for p, (n, s) in paths.items() if n < hosts[p[:1]][0]])
    logit = lambda p: math.log(p / (1 - p))
    seen = set()
    for i, x in got.items():
        (hn, hs), (pn, ps) = hosts[of[i][:1]], paths[of[i]]
        host = (k * mean + hs - e[i]) / (k + hn - 1)
        path = host if pn == hn else (j * host + ps - e[i]) / (j + pn - 1)
        want = 1 / (1 + math.exp(-(logit(e[i]) + 0.5 * (logit(path) - logit(mean)))))
        assert (x.host, x.path) == of[i]
        assert x.evidence == pytest.approx(e[i]) and x.host_posterior == pytest.approx(host) and x.path_posterior == pytest.approx(path) and x.score == pytest.approx(want)
        seen.add((round(host, 3), round(path, 3)))
    assert len(seen) > 20


def test_words_are_evidence(spark):
    """Documents of one shape that differ in their words alone."""
    r = random.Random(5)
    good, bad = ([f"{c}{i:03}" for i in range(150)] for c in "gb")
    rows, labels = [], []
    for i in range(600):
        y = i % 2
        rows.append((i, " ".join(r.choice(good if r.random() < (0.7 if y else 0.3) else bad) for _ in range(40)), "s"))
        labels.append((i, y, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(docs, quality.fit(docs, marks)).join(marks, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(out) > 100 and sum(x.kept == bool(x.quality) for x in out) > 0.97 * len(out)


def test_ratios():
    good, bad = np.array([8.0, 0.0, 4.0]), np.array([0.0, 8.0, 4.0])
    got = quality.log_ratios(good, bad, 8, 8)
    assert got[0] == pytest.approx(math.log(17)) and got[1] == -got[0] and got[2] == 0
