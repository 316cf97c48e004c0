"""Exact dense retrieval by squared L2 distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Questions that together hold at most so many components travel to the vectors as one block; more as several.
BLOCK_COMPONENTS = 2_000_000
#: Vectors of one slice, which meets each of several blocks in a task of its own.
SLICE_ROWS = 50_000
#: Differences held at a time.
_AT_ONCE = 4_000_000
DIGITS = 9


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if column.null_count:
        raise ValueError("a vector is missing")
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends != ends[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(ends), -1)


def _distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(vectors, questions) squared distances, from differences: no product is subtracted from another."""
    if v.shape[1] != q.shape[1]:
        raise ValueError(f"vectors of {v.shape[1]} components meet questions of {q.shape[1]}")
    out = np.empty((len(v), len(q)))
    step = max(1, _AT_ONCE // max(1, q.size))
    for at in range(0, len(v), step):
        d = v[at : at + step, None, :] - q[None]
        out[at : at + step] = np.einsum("ijk,ijk->ij", d, d)
    return np.round(out, DIGITS) + 0.0


class _Nearest:
    """The k nearest of each question so far, ties by id."""

    def __init__(self, qids: pa.Array, q: np.ndarray, k: int):
        self.qids, self.q, self.k = qids, q, k
        self.near = np.full((len(q), 0), np.inf)
        self.ids = np.empty((len(q), 0), object)

    def meet(self, ids: list, v: np.ndarray) -> None:
        order = np.argsort(np.array(ids, object), kind="stable")  # so that a stable sort by distance leaves ties by id
        near = np.concatenate([self.near, _distances(v[order], self.q).T], axis=1)
        names = np.concatenate([self.ids, np.broadcast_to(np.array(ids, object)[order], (len(self.q), len(ids)))], axis=1)
        kept_near, kept_ids = [], []
        for n, i in zip(near, names, strict=True):
            if len(n) > self.k:
                close = np.flatnonzero(n <= np.partition(n, self.k - 1)[self.k - 1])
                n, i = n[close], i[close]
            o = np.lexsort((i, n)) if len(n) else np.empty(0, int)
            kept_near.append(n[o][: self.k])
            kept_ids.append(i[o][: self.k])
        self.near, self.ids = np.stack(kept_near), np.stack(kept_ids)

    def table(self, id_type: pa.DataType) -> pa.RecordBatch:
        n = self.near.shape[1]
        which = pa.array(np.repeat(np.arange(len(self.q)), n))
        return pa.RecordBatch.from_arrays([self.qids.take(which), pa.array(self.ids.ravel().tolist(), id_type), pa.array(self.near.ravel())], names=["qid", "chunk_id", "l2_distance"])


def search(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """corpus (chunk_id, embedding) x questions (qid, embedding) -> qid, rank, chunk_id, l2_distance: the k nearest, ties
    by chunk_id. A missing chunk_id or vector is an error, and so are vectors of different lengths. Exact: every question
    meets every vector, in blocks of both; of each block of vectors only every question's k nearest go on.

    Vectors' partitions stay put while one block of questions travels; several blocks meet slices of the vectors in
    tasks of their own."""
    chunk = F.when(F.col("chunk_id").isNull(), F.raise_error(F.lit("a vector lacks its chunk_id")).cast(corpus.schema["chunk_id"].dataType)).otherwise(F.col("chunk_id"))
    corpus = corpus.select(chunk.alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = questions.select("qid", F.col("embedding").cast("array<double>").alias("q"))
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, l2_distance double"
    n, dim = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    w = Window.partitionBy("qid").orderBy("l2_distance", "chunk_id")
    if n * (dim or 0) <= BLOCK_COMPONENTS:
        sent = asked.toArrow()  # its size counted
        qids, q = sent.column("qid").combine_chunks(), _stacked(sent.column("q").combine_chunks()) if n else np.empty((0, 0))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kind = _Nearest(qids, q, k), pa.string()
            for b in batches:
                kind = b.column("chunk_id").type
                if len(q) and b.num_rows:
                    best.meet(b.column("chunk_id").to_pylist(), _stacked(b.column("v")))
            yield best.table(kind)

        near = corpus.mapInArrow(meet, schema)
    else:
        blocks = -(-n * dim // BLOCK_COMPONENTS)
        slices = -(-corpus.count() // SLICE_ROWS) or 1
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = corpus.withColumn("s", F.pmod(F.xxhash64("chunk_id"), F.lit(slices))).withColumn("b", every(blocks))
        right = asked.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("s", every(slices))

        def meet_block(vs: pa.Table, qs: pa.Table) -> pa.Table:
            qs, vs = qs.combine_chunks(), vs.combine_chunks()
            if not qs.num_rows or not vs.num_rows:
                return pa.table({"qid": qs.column("qid").slice(0, 0), "chunk_id": vs.column("chunk_id").slice(0, 0), "l2_distance": pa.array([], pa.float64())})
            best = _Nearest(qs.column("qid").combine_chunks(), _stacked(qs.column("q").combine_chunks()), k)
            best.meet(vs.column("chunk_id").to_pylist(), _stacked(vs.column("v").combine_chunks()))
            return pa.Table.from_batches([best.table(vs.column("chunk_id").type)])

        near = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(meet_block, schema)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "l2_distance")


def near_ties(hits: DataFrame, k: int, tolerance: float = 1e-6) -> DataFrame:
    """qid, near_ties: pairs of hits next to each other within the first k whose distances differ by less than the
    tolerance; a hit without a distance makes no pair."""
    w = Window.partitionBy("qid").orderBy("rank")
    x = hits.where(F.col("rank") <= k).withColumn("_gap", F.col("l2_distance") - F.lag("l2_distance").over(w))
    return x.groupBy("qid").agg(F.count_if(F.abs("_gap") < tolerance).alias("near_ties"))
