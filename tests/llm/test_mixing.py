"""The mix against a plain one: a list of blocks a source, and a tree that is walked whole."""

import time

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import common, mixing


def leaves(quotas, shards, seed):
    """(first, past) of every shard, by a walk over all nodes."""
    out = {}

    def walk(lo, hi, first, held):
        if hi - lo == 1:
            out[lo] = (first, first + held)
            return
        mid = (lo + hi) // 2
        take = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, int(held.sum()) * (mid - lo) // (hi - lo), method="marginals")
        walk(lo, mid, first, take)
        walk(mid, hi, first + take, held - take)

    walk(0, shards, np.zeros(len(quotas), np.int64), quotas)
    return out


def test_tree():
    q = np.array([1000, 3, 0, 77])
    all_leaves = leaves(q, 13, 7)
    src = np.repeat(np.arange(4), [1100, 5, 1, 80])
    spot = np.concatenate([np.arange(n) for n in (1100, 5, 1, 80)])
    got = mixing.route(q, 13, 7, src, spot)
    for s, p, shard in zip(src, spot, got, strict=True):
        assert shard == next((i for i, (first, past) in all_leaves.items() if first[s] <= p < past[s]), -1)
    sizes = np.bincount(got[got >= 0], minlength=13)
    assert sizes.sum() == 1080 and sizes.max() - sizes.min() <= 4
    known = {}
    assert (mixing.route(q, 13, 7, src[5:9], spot[5:9], known) == got[5:9]).all() and len(known) < 13


def test_a_million_shards():
    """A task visits the nodes above its own places only."""
    q = np.array([3_000_000_000, 500_000_000, 7])  # more blocks than one hypergeometric draw takes
    began = time.perf_counter()
    known = {}
    got = mixing.route(q, 1_000_000, 3, np.array([0, 0, 1, 2, 2]), np.array([0, 2_999_999_999, 250_000_000, 6, 7]), known)
    assert time.perf_counter() - began < 2 and len(known) < 110
    assert got[4] == -1 and (got[:4] >= 0).all() and got[0] < got[1] and abs(got[2] - 500_000) < 5_000
    left = known[0, 1_000_000]
    assert left.sum() == q.sum() // 2 and abs(left[0] / q[0] - 0.5) < 1e-3


def test_what_every_document_gives(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(3)).union(docs.withColumn("source", F.lit(None).cast("string")).limit(20))
    for seed in (11, 12):
        options = {"shard_words": 3000, "block_words": 64, "seed": seed}
        d, draws = mixing.mix(docs, **options)
        rows = d.collect()
        assert len({(r.key, r.dup) for r in rows}) == docs.count()
        blocks = d.where("size > 0").select("key", "dup", "source", "size", "source_size", "target", F.explode(F.expr("sequence(0, cast((size - 1) div 64 as int))")).alias("block"))
        order = {}
        for r in blocks.withColumn("at", common.unit(F.col("key"), F.col("dup"), F.col("block"), F.lit(seed))).collect():
            order.setdefault(r.source, []).append((r["at"], r.key, r.dup, r.block, min(64, r["size"] - 64 * r.block), r.target))
        want, spots = {}, {}
        for source, some in order.items():
            left, spot, epoch = int(some[0][-1]), 0, 0
            while left:
                for _, key, dup, block, words, _ in sorted(some):
                    if left:
                        want[key, dup, epoch, block] = min(words, left)
                        spots[key, dup, epoch, block] = (source, spot)
                        left -= min(words, left)
                        spot += 1
                epoch += 1
        got = {(r.key, r.dup, r.epoch, r.block): r for r in draws.collect()}
        assert {k: r.words for k, r in got.items()} == want
        names = sorted(order, key=lambda s: (s is None, s or ""))
        quota = np.array([sum(s == n for s, _ in spots.values()) for n in names])
        shards = 1 + max(r.shard for r in got.values())
        tree = leaves(quota, shards, seed)
        for k, (source, spot) in spots.items():
            first, past = tree[got[k].shard]
            i = names.index(source)
            assert first[i] <= spot < past[i]
        taken = {}
        for (key, dup, _, _), words in want.items():
            taken[key, dup] = taken.get((key, dup), 0) + words
        assert shards > 5 and sum(taken.values()) == sum(int(some[0][-1]) for some in order.values())
        if seed == 11:
            before = taken
    assert before != taken  # another seed draws other blocks


def test_texts_stand_in_the_order_of_their_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.create_map(F.lit("a"), F.col("doc_id")))
    options = {"shard_words": 3000, "block_words": 64}
    out = mixing.mixed_texts(docs, **options)
    assert out.columns == docs.columns
    draws = mixing.mix(docs, **options)[1]
    parts = draws.groupBy("key", "dup", "epoch", "shard").agg(F.sum("words").alias("words"), F.min("place").alias("place")).collect()
    assert sorted(len(r.text.split()) for r in out.collect()) == sorted(r.words for r in parts)
    ids = {r.key: r.doc_id for r in mixing.mix(docs, **options)[0].collect()}
    files = [[r.doc_id for r in rows] for rows in out.rdd.glom().collect() if rows]
    orders = {}
    for r in sorted(parts, key=lambda r: r.place):
        orders.setdefault(r.shard, []).append(ids[r.key])
    whole = sorted(tuple(o) for o in orders.values())
    joined = []
    for f in files:  # a file holds shards one after another, by number
        for shard in sorted(orders):
            if f[: len(orders[shard])] == orders[shard]:
                joined.append(tuple(orders[shard]))
                f = f[len(orders[shard]) :]
        assert not f
    assert sorted(joined) == whole


def test_a_hot_repeated_row_is_numbered_in_parts(spark):
    docs = spark.createDataFrame([(1, "s", "the same text")] * 3000 + [(i, "s", f"text {i}") for i in range(300)], "doc_id long, source string, text string")
    d, draws = mixing.mix(docs)
    assert d.select("key", "dup").distinct().count() == 3300
    assert {r["n"] for r in d.where("doc_id = 1 and size = 3").groupBy("key").agg(F.countDistinct("dup").alias("n")).collect()} == {3000}
    assert mixing.mixed_texts(docs).count() == draws.groupBy("key", "dup", "epoch", "shard").count().count()
