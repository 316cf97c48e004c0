"""Reciprocal rank fusion and the hybrid retriever."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.vectors import found_by, rrf_term
from plumbline.operators import bm25, dense
from plumbline.session import prepare

RRF_K = 60
POOL = 50
DIGITS = 12
SEARCH_K, CHAT_K = 4, 3
MODES = ("hybrid", "dense")


def resolve_mode(mode: str | None) -> str:
    """Null: hybrid. Unknown: an error."""
    chosen = (mode or "hybrid").lower()
    if chosen not in MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}; one of {MODES}")
    return chosen


def first_places(ranked: DataFrame, keys: list[str], pos: str = "pos", item: str = "chunk_id") -> DataFrame:
    """Each item's first place per keys, renumbered from 1: later repeats shift nothing but themselves."""
    best = ranked.groupBy(*keys, item).agg(F.min(pos).alias("_pos"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_pos", item))).drop("_pos")


def rrf(ranked: DataFrame, k: float = RRF_K, weights: Mapping[str, float] | None = None) -> DataFrame:
    """ranked (qid, arm, pos, chunk_id) -> qid, rank, chunk_id, rrf_score, ranks (map from arm to place).

    A missing weight is 1; an arm of weight 0 still brings its items, with score 0. Ties by chunk_id; the arms' order
    doesn't matter; k must be positive."""
    if k <= 0:
        raise ValueError("k must be positive")
    weight = F.lit(1.0)
    for arm, w in (weights or {}).items():
        weight = F.when(F.col("arm") == arm, F.lit(float(w))).otherwise(weight)
    x = first_places(ranked, ["qid", "arm"])
    fused = x.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(rrf_term(F.col("rank"), k, weight)), DIGITS).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "rank")))).alias("ranks"),  # an entry an arm
    )
    w = Window.partitionBy("qid").orderBy(F.col("rrf_score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).select("qid", "rank", "chunk_id", "rrf_score", "ranks")


def arms(dense_hits: DataFrame, sparse_hits: DataFrame) -> DataFrame:
    """Both arms' hits as one table for rrf()."""
    prepare(dense_hits.sparkSession)
    return dense_hits.select("qid", F.lit("dense").alias("arm"), F.col("rank").alias("pos"), "chunk_id").unionByName(sparse_hits.select("qid", F.lit("bm25").alias("arm"), F.col("rank").alias("pos"), "chunk_id"))


def hybrid(index: bm25.Index, vectors: DataFrame, questions: DataFrame, k: int = SEARCH_K, rrf_k: float = RRF_K, weights: Mapping[str, float] | None = None, payload: DataFrame | None = None) -> DataFrame:
    """questions (qid, text, embedding) -> qid, rank, chunk_id, rrf_score, dense_rank, sparse_rank, l2_distance,
    bm25_score, found_by, and payload's columns by chunk_id. Each arm's pool is max(k, POOL) deep before fusion; an arm
    that lacks an item leaves null."""
    prepare(questions.sparkSession)
    pool = max(k, POOL)
    near = dense.search(vectors, questions, pool)
    sparse = bm25.search(index, questions, pool)
    # One grouping brings ranks, distances and scores together; no join back to either arm.
    rows = near.select("qid", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"), "l2_distance", F.lit(None).cast("double").alias("bm25_score")).unionByName(
        sparse.select("qid", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"), F.lit(None).cast("double").alias("l2_distance"), F.col("score").alias("bm25_score"))
    )
    w = weights or {}
    term = lambda c, arm: F.coalesce(rrf_term(F.col(c), rrf_k, F.lit(float(w.get(arm, 1.0)))), F.lit(0.0))
    fused = rows.groupBy("qid", "chunk_id").agg(*[F.max(c).alias(c) for c in ("dense_rank", "sparse_rank", "l2_distance", "bm25_score")])
    fused = fused.withColumn("rrf_score", F.round(term("dense_rank", "dense") + term("sparse_rank", "bm25"), DIGITS))
    order = Window.partitionBy("qid").orderBy(F.col("rrf_score").desc(), "chunk_id")
    fused = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("found_by", found_by(F.col("dense_rank"), F.col("sparse_rank")))
    out = fused.select("qid", "rank", "chunk_id", "rrf_score", "dense_rank", "sparse_rank", "l2_distance", "bm25_score", "found_by")
    return out.join(payload, "chunk_id", "left") if payload is not None else out


def sweep(ranked: DataFrame, configs: DataFrame, k: int) -> DataFrame:
    """ranked (as rrf's) x configs (config, k, dense_weight, bm25_weight) -> config, qid, rank, chunk_id, rrf_score.

    The arms are retrieved once; each configuration only fuses them anew. configs: all are used; up to 10,000 are broadcast."""
    each = configs.select("config", F.col("k").alias("_k"), "dense_weight", "bm25_weight")
    each = F.broadcast(each) if each.limit(10_001).count() <= 10_000 else each
    x = first_places(ranked, ["qid", "arm"]).crossJoin(each)
    weight = F.when(F.col("arm") == "dense", F.col("dense_weight")).when(F.col("arm") == "bm25", F.col("bm25_weight")).otherwise(1.0)
    fused = x.groupBy("config", "qid", "chunk_id").agg(F.round(F.sum(weight / (F.col("_k") + F.col("rank"))), DIGITS).alias("rrf_score"))
    w = Window.partitionBy("config", "qid").orderBy(F.col("rrf_score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("config", "qid", "rank", "chunk_id", "rrf_score")


def same_rankings(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs of the same questions gave the same ranking."""
    cols = ["qid", "rank", "chunk_id"]
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()
