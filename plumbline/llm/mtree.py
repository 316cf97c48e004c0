"""Exact top-k search by M-trees: paged metric nodes with covering radii and parent distances, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, leanly, table, tune, unit

#: Objects in a leaf page, children of an inner page, objects of a tree, queries that meet a tree together.
PAGE, FAN, TREE_ROWS, QUERY_ROWS = 1024, 24, 16_384, 4096
#: Pivots, and about so many trees more, whose roots every task holds; larger tables get larger trees.
PIVOTS, MOST_TREES = 4096, 16_384
#: Up to this magnitude 64-bit floats hold inner products of components exactly.
EXACT = 1 << 20
#: Bounds computed in floats are widened by this share before they prune.
SLACK = 1e-9


def quantised(embedding: Column) -> Column:
    """floor(64 * x) of each component, x as double."""
    return F.transform(embedding, lambda c: F.floor(64 * c.cast("double")))


def usable(embedding: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(True))


@dataclass
class Space:
    """Vectors are lifted so that inner product falls as distance grows: objects get a last coordinate that brings all
    to the largest norm, queries 0. dim: longest vector; shorter ones are filled with zeros."""

    dim: int
    most: int  # largest squared norm
    exact: bool

    def rows(self, lists) -> np.ndarray:
        out = np.zeros((len(lists), self.dim), np.float64 if self.exact else np.int64)
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(1)))[:, None]])


def _far(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points that lie far from each other, greedily; fewer if others coincide with them."""
    chosen = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n:
        at = int(gap.argmax())
        if gap[at] <= 1e-9:
            break
        chosen.append(at)
        gap = np.minimum(gap, np.linalg.norm(points - points[at], axis=1))
    return np.array(chosen)


def build(ids: np.ndarray, x: np.ndarray, space: Space) -> list[dict]:
    """Pages of an M-tree in depth-first order, the root first.

    A page has a pivot, a radius that covers all its objects, its distance to its parent's pivot, and its objects (ids,
    vectors, distances to its pivot) if it is a leaf."""
    lifted = space.lift(x)
    pages: list[dict] = []

    def add(rows: np.ndarray, parent: int, above: np.ndarray | None) -> None:
        mean = lifted[rows].mean(0)
        pivot = lifted[rows[np.linalg.norm(lifted[rows] - mean, axis=1).argmin()]]
        away = np.linalg.norm(lifted[rows] - pivot, axis=1)
        at = len(pages)
        page = {"page": at, "parent": parent, "pivot": pivot.tobytes(), "radius": float(away.max()), "up": float(np.linalg.norm(pivot - above)) if above is not None else 0.0, "ids": b"", "vectors": b"", "away": b""}
        pages.append(page)
        if len(rows) <= PAGE:
            page |= {"ids": ids[rows].astype(np.int64).tobytes(), "vectors": x[rows].tobytes(), "away": away.tobytes()}
            return
        step, fan = max(1, len(rows) // 2048), min(FAN, -(-2 * len(rows) // PAGE))  # leaves about half full
        seeds = rows[_far(lifted[rows[::step]], fan) * step]
        if len(seeds) == 1:  # all alike
            parts = np.array_split(rows, -(-len(rows) // PAGE))
        else:
            p = lifted[seeds]
            near = ((p * p).sum(1) - 2 * lifted[rows] @ p.T).argmin(1)
            parts = [rows[near == i] for i in range(len(seeds))]
            if max(map(len, parts)) == len(rows):
                parts = np.array_split(rows, FAN)
        for part in parts:
            if len(part):
                add(part, at, pivot)

    add(np.arange(len(ids)), -1, None)
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, space: Space):
        pages = pages.sort_values("page")
        self.space = space
        self.pivot = [np.frombuffer(p) for p in pages["pivot"]]
        self.radius, self.up = pages["radius"].to_numpy(), pages["up"].to_numpy()
        kind = np.float64 if space.exact else np.int64
        self.ids = [np.frombuffer(b, np.int64) for b in pages["ids"]]
        self.vectors = [np.frombuffer(b, kind).reshape(-1, space.dim) for b in pages["vectors"]]
        self.away = [np.frombuffer(b) for b in pages["away"]]
        parent = pages["parent"].to_numpy()
        self.children = [np.flatnonzero(parent == i) for i in range(len(pages))]
        self.stacked = [np.stack([self.pivot[c] for c in kids]) if len(kids) else None for kids in self.children]

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best objects but `own` whose score is at least floor, ties to smaller ids."""
        space = self.space
        lifted = np.append(q.astype(float), 0.0)
        norm = float(lifted @ lifted)
        reach = lambda score: np.sqrt(max(0.0, norm + space.most - 2 * score)) * (1 + SLACK) + 1e-6 if np.isfinite(score) else np.inf  # noqa: E731  objects farther away score less
        ids, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), floor
        limit = reach(least)
        d = float(np.linalg.norm(lifted - self.pivot[0]))
        queue = [(max(0.0, d - self.radius[0]), 0, d)]
        while queue:
            bound, page, d = heapq.heappop(queue)
            if bound > limit:
                break
            kids = self.children[page]
            if len(kids):
                maybe = kids[np.abs(d - self.up[kids]) - self.radius[kids] <= limit]  # no distance computed yet
                if len(maybe):
                    points = self.stacked[page] if len(maybe) == len(kids) else self.stacked[page][np.isin(kids, maybe)]
                    for c, dc in zip(maybe.tolist(), np.linalg.norm(points - lifted, axis=1).tolist(), strict=True):
                        if (b := max(0.0, dc - self.radius[c])) <= limit:
                            heapq.heappush(queue, (b, c, dc))
                continue
            maybe = np.abs(d - self.away[page]) <= limit
            n = np.count_nonzero(maybe)
            if not n:
                continue
            whole = n == len(maybe)
            s = (self.vectors[page] if whole else self.vectors[page][maybe]) @ q
            hit = np.flatnonzero(s >= least)
            if not len(hit):
                continue
            i = (self.ids[page] if whole else self.ids[page][maybe])[hit]
            new = i != own
            ids, scores = np.concatenate([ids, i[new]]), np.concatenate([scores, s[hit][new].astype(np.int64)])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                least = max(least, float(scores.min()))
                limit = reach(least)
        return ids, scores


PAGES = "page int, parent int, pivot binary, radius double, up double, ids binary, vectors binary, away binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score: for each row that is_query picks, the k
    other rows of the largest inner product of quantised() components, ties to smaller vec_id; all, if there are fewer.

    Every vector goes to the nearest of some pivots; each pivot's vectors, dealt by hash into parts of about TREE_ROWS,
    or more if that made over PIVOTS + MOST_TREES of them, make M-trees, so a vector that a third of all rows share
    makes several. A query searches the tree of the nearest
    root first; what it finds there bounds which other roots' balls can hold better objects, and it searches just
    those. Null vec_id, null vectors or vectors with null or non-finite components take no part; vectors of unequal
    lengths are filled with zeros; rows that repeat a vec_id are separate objects, but none is found by a query of its
    own vec_id, and repeated query rows are one query. No rows: no rows."""
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "mtree")
    out_schema = "query_id long, vec_id long, score long"
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("x"), is_query.alias("asks"))
    v = scratch.save(v)
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c)
    n, dim, most, peak = v.agg(F.count("*"), F.max(F.size("x")), F.max(square), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space, rows_a_tree = Space(dim, most, (peak or 0) <= EXACT), max(TREE_ROWS, n // MOST_TREES)
    first = np.stack([space.rows([r["x"]])[0] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(min(PIVOTS, -(-n // rows_a_tree))).collect()])
    pivots = space.lift(first)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.lift(space.rows(b.column("x").to_pylist()))
            near = ((pivots * pivots).sum(1) - 2 * p @ pivots.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["vec_id", "x", "asks", "pivot"])

    v = scratch.save(v.mapInArrow(leanly(nearest), "vec_id long, x array<long>, asks boolean, pivot int"))
    held = {r["pivot"]: r["count"] for r in v.groupBy("pivot").count().collect()}  # a row a pivot
    parts = F.element_at(F.create_map(*[F.lit(z) for p, c in held.items() for z in (p, -(-c // rows_a_tree))]), F.col("pivot"))
    tree = (F.col("pivot").cast("long") * (1 << 32) + F.floor(unit("vec_id") * parts)).alias("tree")

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(build(rows["vec_id"].to_numpy(np.int64), space.rows(rows["x"]), space)).assign(tree=key[0])

    pages = scratch.save(v.select(tree, "vec_id", "x").groupBy("tree").applyInPandas(make, f"{PAGES}, tree long"))
    roots = pages.where("parent < 0").select("tree", "pivot", "radius").collect()  # a row a tree, whose number is bounded
    names, centres, radii = np.array([r["tree"] for r in roots]), np.stack([np.frombuffer(r["pivot"]) for r in roots]), np.array([r["radius"] for r in roots])
    queries = v.where("asks").select("vec_id", "x").dropDuplicates(["vec_id"])

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = space.rows(b.column("x").to_pylist()).astype(float)
                norm = (q * q).sum(1)
                d = np.sqrt(np.maximum(0, norm[:, None] + (centres * centres).sum(1) - 2 * q @ centres[:, :-1].T))
                bound = np.maximum(0, d - radii)
                if first:
                    take = np.zeros(d.shape, bool)
                    take[np.arange(len(d)), (bound + 1e-9 * d).argmin(1)] = True
                    least = np.full(len(d), -np.inf)
                else:
                    least = np.array([-np.inf if s is None else s for s in b.column("least").to_pylist()], float)
                    limit = np.where(np.isfinite(least), np.sqrt(np.maximum(0, norm + space.most - 2 * np.where(np.isfinite(least), least, 0))), np.inf)
                    take = (bound <= limit[:, None] * (1 + SLACK) + 1e-6) & (names[None] != np.array(b.column("seen").to_pylist())[:, None])
                i, t = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(i)), b.column("x").take(pa.array(i)), pa.array(names[t]), pa.array(least[i])], names=["query_id", "q", "tree", "least"])

        return run

    def find(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            t = Tree(held, space)
            for own, q, least in zip(asked["query_id"], space.rows(asked["q"]), asked["least"], strict=True):
                i, s = t.search(own, q, k, least)
                found.append(pd.DataFrame({"query_id": own, "vec_id": i, "score": s}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def searched(routed: DataFrame) -> DataFrame:
        asked = routed.withColumn("block", F.floor(unit("query_id") * blocks))
        wanted = asked.select(F.col("tree").alias("for_tree"), F.col("block").alias("for_block")).distinct()
        copies = pages.join(wanted, F.col("tree") == F.col("for_tree")).drop("tree")
        return asked.groupBy("tree", "block").cogroup(copies.groupBy("for_tree", "for_block")).applyInPandas(find, out_schema)

    home = scratch.save(queries.select("vec_id", "x").mapInArrow(leanly(route(True)), "query_id long, q array<long>, tree long, least double"))
    near = scratch.save(searched(home))
    kth = near.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s")).cast("double").alias("least"))
    more = home.select(F.col("query_id").alias("vec_id"), F.col("q").alias("x"), F.col("tree").alias("seen")).join(kth, "vec_id", "left").select("vec_id", "x", "least", "seen")
    far = searched(more.mapInArrow(leanly(route(False)), "query_id long, q array<long>, tree long, least double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, o.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, o.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v o ON q.vec_id % 20 = 0 AND o.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
