"""The retriever under test and in use: one object that searches in any mode, from saved tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import bm25, dense, fusion
from plumbline.sources.saved import delete, kept
from plumbline.sources.store import Store

#: Indexes of a store's older snapshots that stay on disk, for readers that still use them.
KEPT = 2
#: The ids of so many hits are broadcast, so that of the payload only their rows are shuffled.
BROADCAST_HITS = 100_000


@dataclass
class Retriever:
    """index and vectors (chunk_id, embedding) of one collection, payload (chunk_id, page_content, ...) to show."""

    index: bm25.Index | None
    vectors: DataFrame
    payload: DataFrame
    rrf_k: float = fusion.RRF_K
    weights: Mapping[str, float] = field(default_factory=dict)
    variant: str = "hybrid_rrf60"

    @classmethod
    def of(cls, store: Store, provider: str, **options) -> Retriever:
        """Over a store's collection. Its index is saved beside the store, one for each snapshot, so a write makes a new
        one and nobody searches two states of a collection at once. Without rows of the provider: an error."""
        rows = store.read(provider)
        if rows.isEmpty():
            raise ValueError(f"no collection of {provider!r}")
        number, spark = store.version, store.spark
        base = f"{store.path}/index/{provider}"
        if not _exists(spark, f"{base}/{number}/stats/_SUCCESS"):
            bm25.build(rows.select("chunk_id", F.col("page_content").alias("text"))).save(f"{base}/{number}")
            for old in _children(spark, base):
                if old.isdigit() and int(old) <= number - KEPT:
                    delete(spark, f"{base}/{old}")
        return cls(bm25.Index.load(spark, f"{base}/{number}"), rows.select("chunk_id", "embedding"), rows.drop("embedding", "provider"), **options)

    def only_dense(self) -> Retriever:
        return replace(self, index=None, variant="dense")

    def search(self, questions: DataFrame, k: int = fusion.SEARCH_K, mode: str | None = None, details: bool = False) -> DataFrame:
        """questions (qid, text, embedding) -> qid, rank, chunk_id and the payload's columns; with details the dense mode
        adds l2_distance, the hybrid one rrf_score, dense_rank, sparse_rank, l2_distance, bm25_score and found_by.

        mode: hybrid unless said otherwise; an unknown one is an error. A hit without a chunk_id is an error. The search runs
        now and its hits are kept, as scores and details read them several times."""
        if fusion.resolve_mode(mode) == "dense" or self.index is None:
            hits = dense.search(self.vectors, questions, k)
        else:
            hits = fusion.hybrid(self.index, self.vectors, questions, k, self.rrf_k, self.weights)
        named = F.col("chunk_id").isNotNull() & (F.col("chunk_id") != "")
        hits = hits.where(F.when(named, True).otherwise(F.raise_error(F.lit("a hit lacks its chunk_id: ingest the collection again")).cast("boolean")))
        hits = kept(hits, "hits")
        asked_for = hits.select("chunk_id").distinct()
        asked_for = F.broadcast(asked_for) if hits.count() <= BROADCAST_HITS else asked_for
        shown = [c for c in self.payload.columns if c != "chunk_id" and c not in hits.columns]
        x = hits.join(self.payload.select("chunk_id", *shown).join(asked_for, "chunk_id", "left_semi"), "chunk_id", "left")
        return x.select("qid", "rank", "chunk_id", *([c for c in hits.columns if c not in ("qid", "rank", "chunk_id")] if details else []), *shown)

    def deterministic(self, questions: DataFrame, k: int = 10) -> bool:
        """Whether two searches rank alike."""
        return fusion.same_rankings(self.search(questions, k), self.search(questions, k))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _children(spark, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
