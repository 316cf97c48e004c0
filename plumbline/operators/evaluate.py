"""A run of a retriever over a question set: gate, search, scores, and what each question got."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dense, golden, metrics
from plumbline.operators.retriever import Retriever
from plumbline.sources import files

TOP = 10


@dataclass
class Run:
    """scores: a row a question, as metrics.score_questions gives; details: what it got; strata: means; meta: one row's worth."""

    scores: DataFrame
    details: DataFrame
    meta: dict

    @property
    def strata(self) -> DataFrame:
        return metrics.by_stratum(self.scores)

    def save(self, path: str) -> None:
        """per_question, summary and run_meta under path, as comparisons read them."""
        files.write_run(self.scores.join(self.details, "qid"), self.strata, self.meta, path)


def evaluate(
    retriever: Retriever, qs: DataFrame, vectors: DataFrame, known: DataFrame | None = None, ks: Sequence[int] = metrics.KS, depth: int = metrics.RR_CAP, rr_cap: int = metrics.RR_CAP,
    mode: str | None = None, allow_unknown: bool = False, qids: Sequence[str] | None = None, first: int | None = None, fingerprints: tuple[str | None, str | None] = (None, None), version: str | None = None,
) -> Run:
    """qs (pos and golden.QUESTIONS), vectors (qid, embedding) -> Run.

    Any error of golden.validate() stops the run before a search; with allow_unknown, questions whose gold the collection
    lacks are left out of all means instead. known (chunk_id, text_sha8): the collection, the retriever's own if None.
    fingerprints: of the set and of the collection. qids, first: only these questions, and of them only so many."""
    known = retriever.payload.select("chunk_id", "text_sha8") if known is None else known
    issues = golden.validate(qs, ks, known, *fingerprints)
    usable = golden.select(golden.usable(qs, issues, allow_unknown), qids, first)
    if usable.isEmpty():
        raise ValueError("no questions to score")
    asked = usable.select("qid", F.col("question").alias("text")).join(vectors.select("qid", "embedding"), "qid")
    hits = retriever.search(asked, depth, mode, details=True)
    gold = golden.gold(usable)
    scores = metrics.score_questions(metrics.coverage(metrics.check_groups(gold).select("qid", "semantics", "group_idx", "chunk_id"), hits.select("qid", F.col("rank").alias("pos"), "chunk_id")), ks, rr_cap)
    return Run(scores, details(usable, hits, gold, max(ks)), {"variant": retriever.variant, "retrieval_depth": depth, "rr_cap": rr_cap, "golden_set_version": version, "n_questions": usable.count(), "mode": mode})


def details(qs: DataFrame, hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """qid, question, gold_chunk_ids, provenance, top10, top10_distances (4 digits), top10_found_by, near_ties_in_topk,
    gold_hits (chunk_id, rank, found_by, dense_rank, sparse_rank of gold that was found)."""
    column = lambda name, kind: F.col(name) if name in hits.columns else F.lit(None).cast(kind)
    hits = hits.select("qid", "rank", "chunk_id", column("l2_distance", "double").alias("l2_distance"), column("found_by", "string").alias("found_by"), column("dense_rank", "int").alias("dense_rank"), column("sparse_rank", "int").alias("sparse_rank"))
    row = F.struct("rank", "chunk_id", F.round("l2_distance", 4).alias("d"), "found_by")
    best = hits.where(F.col("rank") <= TOP).groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("t"))  # TOP at most
    best = best.select("qid", F.col("t.chunk_id").alias("top10"), F.col("t.d").alias("top10_distances"), F.col("t.found_by").alias("top10_found_by"))
    found = metrics.gold_hits(gold, hits).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "rank", "found_by", "dense_rank", "sparse_rank"))).alias("gold_hits"))
    ties = dense.near_ties(hits, k).withColumnRenamed("near_ties", "near_ties_in_topk")
    wanted = gold.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_chunk_ids"))
    x = qs.select("qid", "question", "provenance").join(wanted, "qid", "left").join(best, "qid", "left").join(ties, "qid", "left").join(found, "qid", "left")
    return x.withColumn("near_ties_in_topk", F.coalesce("near_ties_in_topk", F.lit(0)))
