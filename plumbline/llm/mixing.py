"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, bucketed, leanly, release, small, table, tune, unit

#: A hypergeometric draw takes from fewer than 10**9 blocks; larger populations are drawn in strata of at most so many.
MOST_BLOCKS = 500_000_000


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: words that the mix takes from each source.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times all words. A target stops
    at `most` times its source's words; what that leaves over is shared again by weight until none is above. That
    fixed point is a water level: with sources ordered by cap / weight, the first one whose cap lies above the level
    of those left settles it. One row a source goes through the windows, never documents. No sources: no rows."""
    one = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.partitionBy().orderBy("r", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("all_words", F.sum("source_size").over(one)).withColumn("i", F.row_number().over(order))
    x = x.withColumn("left", F.lit(float(share)) * F.col("all_words") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
    x = x.withColumn("level", F.col("left") / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    x = x.withColumn("settled", F.min(F.when(F.col("r") >= F.col("level"), F.struct("i", "level"))).over(one)["level"])
    return x.select("source", "source_size", F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("settled"))).alias("target"))


def drawn(held: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n blocks come from each source when `held` are there: multivariate hypergeometric, in strata of all
    sources in proportion where there are too many blocks for one draw."""
    strata = int(held.sum()) // MOST_BLOCKS + 1
    cut = [(held * i // strata, n * i // strata) for i in range(strata + 1)]
    out = np.zeros(len(held), np.int64)
    owed = 0
    for (a, m), (b, k) in itertools.pairwise(cut):
        want = k - m + owed  # a stratum short of blocks leaves the rest to the next
        here = min(want, int((b - a).sum()))
        owed = want - here
        out += rng.multivariate_hypergeometric(b - a, here, method="marginals")
    left = held - out
    for i in np.argsort(-left, kind="stable"):  # what rounding left after the last stratum
        more = min(owed, int(left[i]))
        out[i] += more
        owed -= more
    return out


def route(quotas: np.ndarray, shards: int, seed: int, src: np.ndarray, spot: np.ndarray, known: dict | None = None) -> np.ndarray:
    """The shard that draws each (source number, place in the source's order); -1: none, as it lies beyond the quota.

    The root holds all sources' exact block quotas. A node hands its left half of shards a multivariate hypergeometric
    draw from what it holds and the right half the rest, so a leaf is a shard's quota of every source and draws the
    next so many places of its order. Only nodes above the places asked for are visited; each has a seed of its own, so
    every task finds the same tree. known: draws of nodes met before, for later calls."""
    out = np.full(len(src), -1, np.int64)
    quotas = np.asarray(quotas, np.int64)
    known = {} if known is None else known
    open_nodes = [(0, shards, np.zeros(len(quotas), np.int64), quotas, np.flatnonzero(spot < quotas[src]))] if len(src) else []
    while open_nodes:
        lo, hi, first, held, rows = open_nodes.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows] = lo
            continue
        mid = (lo + hi) // 2
        take = known.get((lo, hi))
        if take is None:
            if len(known) > 20_000:
                known.clear()
            take = known[lo, hi] = drawn(held, int(held.sum()) * (mid - lo) // (hi - lo), np.random.default_rng([seed, lo, hi]))
        left = spot[rows] < (first + take)[src[rows]]
        open_nodes += [(lo, mid, first, take, rows[left]), (mid, hi, first + take, held - take, rows[~left])]
    return out


def keyed(docs: DataFrame, text_hash: F.Column, scratch: Scratch) -> DataFrame:
    """Adds key and dup, which together name a row of docs: a hash, and a number among rows that share it. Rows that
    repeat are saved with a place of their own and ranked without a window that spans a key."""
    x = docs.withColumn("key", F.xxhash64("doc_id", "source", text_hash))
    again = scratch.save(x.groupBy("key").count().where("count > 1").select("key"), narrow=True)
    if again.isEmpty():
        return x.withColumn("dup", F.lit(1))
    several = small(again, 16)
    rows = scratch.save(x.join(several, "key", "left_semi").withColumn("_at", unit(F.monotonically_increasing_id())))
    ranked = bucketed(rows, ["key"], "_at", rows.count(), ties=[]).withColumn("dup", (F.col("rank") + 1).cast("int")).drop("rank", "_at")
    return x.join(several, "key", "left_anti").withColumn("dup", F.lit(1)).unionByName(ranked)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 1024, shard_words: int = 4_000_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, source, ...) -> (documents, draws).

    documents: a row for each row of docs, with doc_id, source, size, source_size, target, key and dup, as keyed() adds.
    draws: one row for each block that a shard draws, with key, dup, epoch, block, words (the first so many of the
    block), shard and place (the order inside the shard, hashed). Blocks are runs of block_words words of one document.
    A source's order is its blocks in permuted order, epoch after epoch; its quota is the number of blocks that meet its
    target. The splitting tree shares all quotas out among shards; what no shard draws isn't in the mix. The last block
    of a quota is cut, so a source's words differ from its target by under one and no document exceeds
    ceil(target / source_size) <= `most` times its size.

    Null text or one without words: size 0, never drawn. Null source: a source of its own. Rows that repeat, also
    with the same doc_id, are separate documents. No rows: no rows. Reruns agree: places come from hashes. The driver
    and every task hold some numbers for each source, so sources are counted in thousands, not by document."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "mix")
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    base = scratch.save(keyed(base, F.col("h"), scratch).drop("h"), narrow=True)
    per_source = scratch.save(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), 1)
    n = scratch.rows = base.count()
    all_words = per_source.agg(F.sum("source_size")).first()[0] or 0
    whole = F.floor("target").cast("long")
    plan = per_source.select(
        F.col("source").alias("s"), F.coalesce(F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")), F.lit(0)).alias("full"),
        F.coalesce(F.when(F.col("source_size") > 0, whole % F.col("source_size")), F.lit(0)).alias("rest"),
    )
    documents = base.join(small(per_source.withColumnRenamed("source", "s"), 96), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    blocks = base.where("size > 0").select("key", "dup", "source", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words).cast("int"))).alias("block"))
    blocks = blocks.select("key", "dup", "source", "block", F.least(F.lit(block_words), F.col("size") - F.col("block").cast("long") * block_words).alias("words"), unit(F.col("key"), F.col("dup"), F.col("block"), F.lit(seed)).alias("at"))
    dealt = scratch.save(bucketed(blocks, ["source"], "at", max(n, 1), "words").join(small(plan, 96), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), narrow=True)

    counts = dealt.groupBy("source").agg(F.count("*").alias("n"), F.first("full").alias("full"), F.sum((F.col("before") < F.col("rest")).cast("long")).alias("part"))
    quota = {r["source"]: (r["n"], int(r["full"]), int(r["part"])) for r in counts.collect()}  # one row a source
    names = sorted(quota, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    held = np.array([quota[s][0] * quota[s][1] + quota[s][2] for s in names], np.int64)
    shards = max(1, min(int(held.sum()), -(-int(all_words * share) // shard_words)))
    in_source = np.array([quota[s][0] for s in names], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            src = np.array([number[s] for s in b.column("source").to_pylist()], np.int64)
            spot = b.column("epoch").to_numpy() * in_source[src] + b.column("rank").to_numpy()
            shard = route(held, shards, seed, src, spot, known)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "dup", "epoch", "block", "words")), pa.array(shard)], names=["key", "dup", "epoch", "block", "words", "shard"])
            yield out.filter(pa.array(shard >= 0))

    # Each block stands once for every whole epoch, and once for the last one, whose quota ends where the target is met.
    each = dealt.select("key", "dup", "source", "block", "rank", "words", "full", F.least("words", F.col("rest") - F.col("before")).alias("cut"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch"))
    chosen = each.select("key", "dup", "source", "epoch", F.col("block").cast("long").alias("block"), "rank", F.when(F.col("epoch") < F.col("full"), F.col("words")).otherwise(F.col("cut")).cast("long").alias("words"))
    draws = chosen.mapInArrow(leanly(place), "key long, dup int, epoch long, block long, words long, shard long")
    return documents, draws.withColumn("place", F.xxhash64("key", "dup", "epoch", "block", F.lit(seed + 1)))


_word = re.compile(WORD)


def render(text: str, parts: list[tuple[int, int]], block_words: int) -> str:
    """The text of the drawn blocks; parts: (block, words) by block. Untouched white space inside a block stays."""
    spans = [m.span() for m in _word.finditer(text)]
    runs: list[list[int]] = []
    for block, n in parts:
        lo, hi = block * block_words, block * block_words + n
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each shard and epoch that draws part of a document, with its drawn text and
    n_chars. Rows of a shard stand together in the order of their first block's place.

    Column order and extra columns stay; documents that the mix doesn't draw go."""
    block_words = options.setdefault("block_words", 1024)
    scratch = Scratch(docs.sparkSession, "mixed")
    documents, draws = mix(docs, **options)
    parts = draws.groupBy("key", "dup", "epoch", "shard").agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("parts"), F.sum("words").alias("drawn"), F.min("place").alias("place"))  # blocks of one document
    parts = parts.join(documents.select("key", "dup", "size"), ["key", "dup"]).select("key", "dup", F.col("shard").alias("_shard"), F.col("place").alias("_place"), F.when(F.col("drawn") < F.col("size"), F.col("parts")).alias("_parts"))
    rows = keyed(docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_all", "doc_id", "source", "text"), F.xxhash64("text"), scratch)
    rows = rows.select("_all", "text", "key", "dup").join(parts, ["key", "dup"])
    some = F.pandas_udf(lambda t, p: _render_all(t, p, block_words), "string")
    part = F.col("_parts").isNotNull()
    rows = rows.withColumn("_drawn", some(F.when(part, F.col("text")), "_parts"))
    text = F.when(part, F.col("_drawn")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    out = rows.select(F.struct(*[new.get(c, F.col("_all").getField(c)).alias(c) for c in docs.columns]).alias("_row"), "_shard", "_place")
    return out.repartition("_shard").sortWithinPartitions("_shard", "_place").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _render_all(texts, parts, block_words):
    import pandas as pd

    release()
    return pd.Series([None if ps is None else render(t, [(p["block"], p["words"]) for p in ps], block_words) for t, ps in zip(texts, parts, strict=True)], dtype=object)


def query(spark, sf_dir: str) -> DataFrame:
    documents, draws = mix(table(spark, sf_dir, "documents"))
    taken = draws.groupBy("key", "dup").agg(F.sum("words").alias("taken"), F.count("*").alias("blocks"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = documents.join(taken, ["key", "dup"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.coalesce("blocks", F.lit(0)).alias("blocks"), "first_shard", "last_shard")
