"""Incremental ingest: a file stream of pages whose chunks are upserted, one version a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.chunking import chunk
from plumbline.sources.files import PAGE
from plumbline.sources.store import Store


def to_rows(pages: DataFrame, provider: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks of pages (source, page, page_content) as rows of the store."""
    x = chunk(pages)
    extra = F.map_from_arrays(F.array(F.lit("source")), F.array(F.col("source")))
    return x.select("chunk_id", "arxiv_id", "page", "ordinal", "page_content", "text_sha8", embed(F.col("page_content")).alias("embedding"), extra.alias("metadata"), F.lit(provider).alias("provider"))


def hashed_embedding(text: Column, dim: int = 16) -> Column:
    """A stand-in for a model, of word hashes: repeatable and free of any download."""
    words = F.split(F.lower(text), r"\s+")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) == i)) / F.sqrt(F.size(words).cast("double"))).cast("float"))


def ingest(pages: DataFrame, store: Store, provider: str, embed: Callable[[Column], Column] = hashed_embedding) -> None:
    """Replaying pages changes nothing."""
    store.upsert(to_rows(pages, provider, embed))


def watch(spark: SparkSession, landing: str, store: Store, provider: str, checkpoint: str, embed: Callable[[Column], Column] = hashed_embedding, on_change: Callable[[], None] | None = None) -> StreamingQuery:
    """Ingests page files (JSON lines) as they land. A batch that runs again after a failure upserts the same rows;
    on_change lets go of indexes built from the old version."""

    def batch(pages: DataFrame, _: int) -> None:
        if not pages.isEmpty():
            ingest(pages, store, provider, embed)
            if on_change:
                on_change()

    stream = spark.readStream.schema(PAGE).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
