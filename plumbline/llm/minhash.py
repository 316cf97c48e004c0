"""Near-duplicates by b-bit MinHash: band candidates, bit-count estimates, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, leanly, shingle_hashes, small, table, tune, words
from .components import components

#: Bands of rows minima each. A pair at Jaccard 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Low bits kept of each minimum; 16 of them fill a long.
BITS = 4
#: The estimate of a pair at 0.8 has a standard deviation of 0.037; candidates under threshold - MARGIN are over 5 below.
MARGIN = 0.2
#: Candidates down to threshold - FAR are compared with their bucket's first node, to learn how they differ from it.
FAR = 0.5
#: Nodes of a bucket that meet in one block of the last join, from all of it and from outside its largest component.
CELL, OUTSIDE = 512, 4096
#: Rows of such buckets in a task.
MEETING = 4096
#: Bits of the masks that record which shingles a set adds to or lacks of another.
MASK = 512

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_ONES = 0x1111111111111111

SKETCH = "n_shingles long, d0 long, d1 long, bands array<long>, sig array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(PERMUTATIONS, sets) unsigned 32-bit minima. Sets: non-empty arrays of 64-bit hashes."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((PERMUTATIONS, len(sets)), np.uint32)
    buffer = np.empty_like(x)
    for i in range(PERMUTATIONS):
        np.multiply(x, _A[i], out=buffer)
        np.add(buffer, _B[i], out=buffer)
        out[i] = np.minimum.reduceat(buffer, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys that differ between bands."""
    m = least.reshape(BANDS, ROWS, -1).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407) + np.uint64(1)
    for r in range(ROWS):
        h = (h ^ m[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.ascontiguousarray(h.T).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """(sets, PERMUTATIONS * BITS / 64) longs of the low bits of the minima, mixed first as minima are small numbers."""
    m = least * np.uint32(0x9E3779B1)
    m ^= m >> np.uint32(15)
    m = ((m * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint64)
    m = m.reshape(-1, 16, least.shape[1])
    return np.ascontiguousarray(np.bitwise_or.reduce(m << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None], axis=1).T).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Jaccard estimate from packed signatures: equal BITS-wide groups by bit counts, less chance collisions."""
    differ = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def _sets(batch: pa.RecordBatch, shingle: int, known: WordHashes) -> list[np.ndarray]:
    return [shingle_hashes(np.array([known[w] for w in words(t)], np.uint64), shingle) for t in batch.column("text").to_pylist()]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, digest (d0, d1) of the whole set, band keys and packed signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = _sets(b, shingle, known)
            digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                least = minima([sets[i] for i in some])
                for i, k, s in zip(some, band_keys(least), packed(least), strict=True):
                    bands[i], sigs[i] = k, s
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([d >> sh & (1 << 64) - 1 for d in digest], np.uint64).view(np.int64)) for sh in (64, 0)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d0", "d1", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(leanly(run), "doc_id long, " + SKETCH)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (node, d0, d1, text) -> node, set (array of long), for rows whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = _sets(b, shingle, known)
            keep = [i for i, (s, d0, d1) in enumerate(zip(sets, b.column("d0").to_pylist(), b.column("d1").to_pylist(), strict=True)) if xxhash.xxh3_128_intdigest(s.tobytes()) == (d0 & (1 << 64) - 1) << 64 | d1 & (1 << 64) - 1]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select("node", "d0", "d1", "text").mapInArrow(leanly(run), "node long, set array<long>")


def _mask(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(MASK, bool)
    bits[hashes & np.uint64(MASK - 1)] = True
    return np.packbits(bits).view(np.int64)


COMPARED = "a long, b long, size_b long, shared long, size_a long, added array<long>, lacks array<long>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) -> sizes, how many they share, and masks of what b adds to a and lacks of it."""
    for batch in batches:
        sets = []
        for name in ("set_a", "set_b"):
            c = batch.column(name)
            v, o = c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()
            sets.append([v[o[i] : o[i + 1]] for i in range(len(c))])
        n, added, lacks = [], [], []
        for x, y in zip(*sets, strict=True):
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            same = x[at] == y
            other = np.ones(len(x), bool)
            other[at[same]] = False
            n.append((len(y), int(same.sum()), len(x)))
            added.append(_mask(y[~same]))
            lacks.append(_mask(x[other]))
        columns = np.array(n, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c) for c in columns), pa.array(added, pa.list_(pa.int64())), pa.array(lacks, pa.list_(pa.int64()))], names=["a", "b", "size_b", "shared", "size_a", "added", "lacks"])


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """pairs (a, b) of nodes -> COMPARED, from full sets.

    The sets of the nodes in question are made again from their texts: fewer bytes than keeping all sets. Joins on a
    node that many pairs share split, as the other side has one row a node."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.save(wanted.join(nodes.select("node", "first_id", "d0", "d1"), "node").select("node", F.col("first_id").alias("doc_id"), "d0", "d1"), narrow=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(small(wanted, 40), F.col("_id").eqNullSafe(F.col("doc_id")))
    sets = scratch.save(full_sets(texts, shingle))
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    out = scratch.save(both.select("a", "b", "set_a", "set_b").mapInArrow(leanly(_compare), COMPARED), narrow=True)
    scratch.drop(wanted, sets)
    return out


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))


def _bits(a: Column) -> Column:
    n = F.lit(0)
    for i in range(MASK // 64):
        n = n + F.bit_count(a[i])
    return n


def _most_shared(o: str, x: str) -> Column:
    """No pair shares more shingles than this, by how both differ from one third set (size, what they add and lack).

    Of that set they share what neither lacks: lacking bits of one that the other has not set are shingles more. Of
    the rest they share at most what one adds, less its bits that the other has not set."""
    col = lambda side, name: F.col(f"{side}_{name}")
    common = others_o = others_x = F.lit(0)
    for i in range(MASK // 64):
        common = common + F.bit_count(col(o, "added")[i].bitwiseAND(col(x, "added")[i]))
        others_o = others_o + F.bit_count(col(o, "lacks")[i].bitwiseAND(F.bitwise_not(col(x, "lacks")[i])))
        others_x = others_x + F.bit_count(col(x, "lacks")[i].bitwiseAND(F.bitwise_not(col(o, "lacks")[i])))
    n_added = lambda side: col(side, "size") - col(side, "shared")
    n_lacks = lambda side: col(side, "third") - col(side, "shared")
    inside = col(o, "third") - F.greatest(n_lacks(o) + others_x, n_lacks(x) + others_o)
    beside = F.least(n_added(o) - col(o, "added_bits") + common, n_added(x) - col(x, "added_bits") + common)
    return inside + beside


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents are linked if their sets of `shingle`-word runs have a Jaccard similarity of at least percent / 100;
    components of links share a component_id. Rows with equal sets form one node. Candidates share a band of minima.

    First each node meets the first node (by doc_id) of each of its buckets; confirmed links are contracted. In up to
    `rounds` turns, nodes outside the largest component of a bucket meet one of its nodes, the likeliest first. Then,
    in buckets that still hold several components, every node outside the largest meets all nodes of others: pairs
    whose estimate lies far below the threshold, or which share too few shingles by how both differ from the bucket's
    first node (a bound that never errs), drop out inside the join; full sets decide the rest. That join is dealt out
    in blocks, so a hot bucket is many tasks' work. No bucket's pairs are all written out, though those outside its
    largest component are all looked at; none is capped, and no candidate that could join two components goes unseen.

    Null, empty or white-space text: an empty set, linked with nothing, component_id = doc_id. Fewer words than
    `shingle`: all words as one shingle. Null doc_id: never the smallest; without any other its
    component_id is null and, as the two are equal, it is kept. Repeated rows: one component. No rows: no
    rows."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "minhash")
    rows = scratch.save(sketches(docs, shingle))
    scratch.rows = rows.count()
    full = rows.where("n_shingles > 0")
    keep = lambda df: scratch.save(df, narrow=True)
    nodes = full.groupBy("d0", "d1").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = keep(nodes.withColumn("node", F.coalesce("first_id", "d0")))
    sig = nodes.select("node", "sig")
    bound = percent / 100

    def buckets(of: DataFrame, *more: str) -> DataFrame:
        return of.select("node", *more, F.explode("bands").alias("key"))

    def screened(pairs: DataFrame, least: float) -> DataFrame:
        sides = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        return sides.withColumn("like", estimate(F.col("sa"), F.col("sb"))).where(F.col("like") >= least).drop("sa", "sb")

    first = keep(buckets(nodes).groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a"))
    stars = buckets(nodes).join(first, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    star = _compared(keep(screened(stars, bound - FAR).select("a", "b")), docs, nodes, shingle, scratch)
    edges = star.where(_linked(percent)).select("a", "b")
    roots = components(edges, scratch)
    seen = star.select("a", "b")

    def scattered() -> DataFrame:
        """Rows of the buckets that hold several components: key, node, root, sig, main (the largest component)."""
        placed = keep(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bands", "sig"))
        mixed = buckets(placed, "root").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = keep(buckets(placed, "root", "sig").join(small(mixed, 16), "key"))
        counts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = keep(counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main")))  # read back, so that a hot bucket's rows can be split
        return members.join(small(main, 24), "key")

    for turn in range(rounds):
        members = keep(scattered())
        lead = members.where("root = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), F.col("node").alias("l"), F.col("sig").alias("sl"), F.col("root").alias("rl"))).alias("lead"))
        lead = keep(lead.select("key", "lead.l", "lead.sl", "lead.rl"))
        tries = members.where("root <> main").join(small(lead, 160), "key").withColumn("like", estimate(F.col("sig"), F.col("sl"))).where(F.col("like") >= bound - MARGIN)
        tries = tries.groupBy("node", "rl").agg(F.max_by("l", F.struct("like", "l")).alias("l")).select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
        tries = keep(tries.join(seen, ["a", "b"], "left_anti"))
        more = None if tries.isEmpty() else _compared(tries, docs, nodes, shingle, scratch)
        scratch.drop(members)
        if more is None:
            break
        seen, found = keep(seen.union(tries)), more.where(_linked(percent)).select("a", "b")
        if found.isEmpty():
            break
        edges = edges.union(found)
        roots = components(edges, scratch)

    differ = star.select(F.col("a").alias("third_node"), F.col("b").alias("node"), F.col("size_b").alias("size"), "shared", F.col("size_a").alias("third"), "added", "lacks")
    zero = F.array(*[F.lit(0).cast("long")] * (MASK // 64))
    own = star.groupBy(F.col("a").alias("node")).agg(F.first("size_a").alias("size")).select(F.col("node").alias("third_node"), "node", "size", F.col("size").alias("shared"), F.col("size").alias("third"), zero.alias("added"), zero.alias("lacks"))
    differ = differ.union(own).withColumn("added_bits", _bits(F.col("added")))
    members = keep(scattered().join(first.withColumnRenamed("a", "third_node"), "key").join(differ, ["third_node", "node"], "left"))
    # A bucket's rows fall in blocks of about CELL nodes that meet and OUTSIDE of those outside the largest component.
    grid = keep(members.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("across"), F.ceil(F.count_if(F.col("root") != F.col("main")) / OUTSIDE).cast("int").alias("down")))
    members_n = members.count()
    members = members.join(small(grid, 32), "key")
    one = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    fields = ["size", "shared", "third", "added", "lacks", "added_bits"]
    side = lambda name, rows, *block: rows.select("key", *block, *[F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "sig", *fields)], *([(F.col("root") == F.col("main")).alias("core")] if name == "x" else []))
    most = _most_shared("o", "x")
    able = F.coalesce(100 * most >= percent * (F.col("o_size") + F.col("x_size") - most), F.lit(True))
    apart = (F.col("o_root") != F.col("x_root")) & (F.col("core") | (F.col("o_node") < F.col("x_node")))
    met = ["key", "across", "down"]
    dealt = lambda rows: rows.repartition(int(min(20_000, 1 + members_n // MEETING)), *met)  # noqa: E731 by rows, as their pairs and not their bytes take time
    late = dealt(side("o", members.where("root <> main"), every("across"), one("down", 2))).join(dealt(side("x", members, one("across", 1), every("down"))), met).where(apart & able & (estimate(F.col("o_sig"), F.col("x_sig")) >= bound - MARGIN))
    late = late.select(F.least("o_node", "x_node").alias("a"), F.greatest("o_node", "x_node").alias("b")).distinct()
    late = keep(late.join(seen, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        found = keep(_compared(late, docs, nodes, shingle, scratch).where(_linked(percent)).select("a", "b"))
        if not found.isEmpty():
            roots = components(edges.union(found), scratch)

    found = nodes.join(roots, "node", "left").select("d0", "d1", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = found.join(smallest, "root").select("d0", "d1", "component_id")
    out = rows.select("doc_id", "n_shingles", "d0", "d1").join(keep(of_class), ["d0", "d1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out._scratch = scratch  # for callers that save the result and want the space back
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
