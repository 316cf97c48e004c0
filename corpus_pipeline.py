"""Corpus preparation: language ID, near-dedup, substring dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame. All but
the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, minhash, mixing, packing, spans
from plumbline.llm.common import Scratch, small, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of whose text known languages together make up less than half, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word runs, similarity 0.8 or more) the document of the smallest doc_id stays.

    Documents without words stay. Rows that share a doc_id are told apart by their text, as are rows without one, which
    stand behind all numbered ones. Of rows with equal doc_id and text one stays."""
    scratch = Scratch(spark, "near")
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    named = docs.withColumn("_own", own)
    texts = scratch.save(named.groupBy("_own", F.xxhash64("text").alias("_text")).agg((F.count("*") > 1).alias("_equal")), narrow=True)
    equal = not texts.where("_equal").isEmpty()
    if not texts.groupBy("_own").count().where("count > 1").isEmpty():
        # New numbers in the order of doc_id and hash of the text: partitions of a sort follow each other.
        numbers = scratch.save(texts.select("_own", "_text").orderBy("_own", "_text").withColumn("_number", F.monotonically_increasing_id()))
        named = named.withColumn("_text", F.xxhash64("text")).join(small(numbers, 24), ["_own", "_text"]).withColumn("_own", F.col("_number")).drop("_text", "_number")
        named = scratch.save(named)
    near = minhash.near_duplicates(named.select(F.col("_own").alias("doc_id"), "text"))
    found = scratch.save(near)
    near._scratch.close()
    kept = found.where("kept").select(F.col("doc_id").alias("_own")).distinct()
    out = named.join(small(kept, 16), "_own", "left_semi")
    if equal:
        out = out.dropDuplicates(["_own"])
    return out.drop("_own")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose sentences of repeated spans; n_chars follows."""
    out = spans.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix draws them."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every drawn document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL expresses the learned and iterative stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
