"""Question sets: reading, validation as rows, leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as T
from plumbline.session import prepare

LEAKAGE = 0.35
QUESTIONS = (
    "qid string, question string, semantics string, gold_groups array<struct<chunk_ids:array<string>,note:string>>, "
    "expected_answer string, source_papers array<string>, provenance string, tags array<string>, chunk_text_sha8 map<string,string>"
)
GOLDEN_SET = f"version string, corpus_fingerprint string, chunking map<string,int>, questions array<struct<{', '.join(f'{p[0]}:{p[1]}' for p in (x.split(' ', 1) for x in QUESTIONS.split(', ')))}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a golden set."""
    return spark.read.schema(GOLDEN_SET).json(path, multiLine=True)


def write(golden: DataFrame, path: str) -> None:
    golden.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def questions(golden: DataFrame) -> DataFrame:
    return golden.select(F.posexplode("questions").alias("pos", "q")).select("pos", "q.*")


def gold(qs: DataFrame) -> DataFrame:
    """questions -> qid, semantics, group_idx, chunk_id."""
    return qs.select("qid", "semantics", F.posexplode("gold_groups").alias("group_idx", "g")).select("qid", "semantics", "group_idx", F.explode("g.chunk_ids").alias("chunk_id"))


def validate(qs: DataFrame, ks: Sequence[int] = (5, 10), known: DataFrame | None = None, set_fingerprint: str | None = None, collection_fingerprint: str | None = None) -> DataFrame:
    """qs (pos and the columns of QUESTIONS) -> severity, code, qid, detail: a row an issue.

    known (chunk_id, text_sha8): the collection; without it UNKNOWN_CHUNK_ID and TEXT_DRIFT aren't looked for.
    Questions with an empty qid, or without groups, are reported and not looked into further."""
    spark = prepare(qs.sparkSession)
    named = qs.where(F.coalesce(F.col("qid"), F.lit("")) != "")
    full = named.where(F.coalesce(F.size("gold_groups"), F.lit(0)) > 0)
    issue = lambda df, severity, code, detail: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "qid", detail.alias("detail"))
    nothing = F.lit("")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    groups = full.select("pos", "qid", "semantics", F.posexplode("gold_groups").alias("group_idx", "g")).select("pos", "qid", "semantics", "group_idx", F.coalesce("g.chunk_ids", F.expr("array()")).alias("ids"))
    members = groups.select("pos", "qid", "group_idx", F.posexplode("ids").alias("i", "chunk_id"))
    n = F.size("gold_groups")
    least = min(ks) if ks else 5
    located = groups.where("semantics = 'all_required'").withColumn("at", T.parse_chunk_id(F.get(F.filter("ids", lambda c: c.rlike(T.CHUNK_ID)), F.lit(0)), strict=False)).where("at is not null").select("pos", "qid", "group_idx", "at")
    a, b = located.alias("a"), located.alias("b")
    beside = (F.col("a.pos") == F.col("b.pos")) & (F.col("a.at.arxiv_id") == F.col("b.at.arxiv_id")) & (F.col("a.at.page") == F.col("b.at.page")) & (F.col("a.group_idx") < F.col("b.group_idx")) & (F.abs(F.col("a.at.ordinal") - F.col("b.at.ordinal")) <= 1)
    found = [
        issue(qs.where(F.coalesce(F.col("qid"), F.lit("")) == "").withColumn("qid", F.lit(None).cast("string")), "error", "DUP_QID", F.lit("empty qid")),
        issue(named.withColumn("_n", number).where("_n > 1"), "error", "DUP_QID", nothing),
        issue(named.where(F.coalesce(F.size("gold_groups"), F.lit(0)) <= 0), "error", "EMPTY_GROUPS", nothing),
        issue(groups.where(F.size("ids") == 0), "error", "EMPTY_GROUP", F.col("group_idx").cast("string")),
        issue(groups.where(F.size(F.array_distinct("ids")) < F.size("ids")), "warn", "DUP_ID_IN_GROUP", F.col("group_idx").cast("string")),
        issue(members.where(~F.coalesce(F.col("chunk_id").rlike(T.CHUNK_ID), F.lit(False))), "error", "BAD_ID_FORMAT", F.coalesce("chunk_id", F.lit("NULL"))),
        # A member in another group than the one before it, in reading order, is one overlap.
        issue(members.withColumn("_last", F.lag("group_idx").over(Window.partitionBy("pos", "chunk_id").orderBy("group_idx", "i"))).where("_last <> group_idx"), "error", "GROUPS_OVERLAP", F.col("chunk_id")),
        issue(full.where(F.when(F.col("semantics") == "any_of", n != 1).when(F.col("semantics") == "all_required", n < 2).otherwise(True)), "error", "SEMANTICS_MISMATCH", F.coalesce("semantics", F.lit("NULL"))),
        issue(a.join(b, beside).select(F.col("a.qid").alias("qid"), F.concat_ws("/", F.col("a.group_idx"), F.col("b.group_idx")).alias("_d")), "warn", "SUSPICIOUS_MULTIHOP", F.col("_d")),
        issue(full.where(n > least), "warn", "N_GROUPS_EXCEEDS_K", n.cast("string")),
    ]
    if known is not None:
        ids = known.select(F.col("chunk_id").alias("_id")).distinct()
        found.append(issue(members.select("pos", "qid", "chunk_id").join(ids, F.col("chunk_id") == F.col("_id"), "left_anti"), "error", "UNKNOWN_CHUNK_ID", F.coalesce("chunk_id", F.lit("NULL"))))
        expected = full.select("qid", F.explode("chunk_text_sha8").alias("_id", "_expected"))
        found.append(issue(expected.join(known.select(F.col("chunk_id").alias("_id"), "text_sha8"), "_id").where("_expected <> text_sha8"), "error", "TEXT_DRIFT", F.col("_id")))
    if collection_fingerprint is not None and set_fingerprint != collection_fingerprint:
        found.append(issue(spark.range(1).select(F.lit(None).cast("string").alias("qid")), "error", "FINGERPRINT_MISMATCH", nothing))
    return reduce(DataFrame.unionByName, found)


def usable(qs: DataFrame, issues: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """The questions to run. Any error stops the run; with allow_unknown, questions whose only errors are unknown chunks
    are left out instead."""
    errors = issues.where("severity = 'error'")
    stopping = errors.where("code <> 'UNKNOWN_CHUNK_ID'") if allow_unknown else errors
    worst = stopping.select("code", "qid", "detail").limit(10).collect()
    if worst:
        raise ValueError("the question set has errors: " + "; ".join(f"{r['code']} {r['qid']} {r['detail']}" for r in worst))
    return qs.join(errors.select("qid").distinct(), "qid", "left_anti")


def leakage(qs: DataFrame, chunks: DataFrame) -> DataFrame:
    """qs (qid, question, chunk_id), chunks (chunk_id, text) -> qid, chunk_id, jaccard of content words (4 digits), flagged."""
    x = qs.join(chunks.select("chunk_id", "text"), "chunk_id")
    j = T.jaccard(T.content_words(F.col("question")), T.content_words(F.col("text")))
    return x.select("qid", "chunk_id", F.round(j, 4).alias("jaccard"), (j >= LEAKAGE).alias("flagged"))


def leakage_summary(leaks: DataFrame) -> DataFrame:
    """The upper of the middle values, smallest, largest and number flagged. Values have four digits, so there are at most
    10,001 to put in order."""
    counts = leaks.groupBy("jaccard").agg(F.count("*").alias("_n"), F.count_if("flagged").alias("_f"))
    up_to = Window.partitionBy().orderBy("jaccard")
    x = counts.withColumn("_to", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return x.agg(F.min(F.when(F.col("_to") > F.expr("_all div 2"), F.col("jaccard"))).alias("median"), F.min("jaccard").alias("min"), F.max("jaccard").alias("max"), F.coalesce(F.sum("_f"), F.lit(0)).alias("n_flagged"))


def select(qs: DataFrame, qids: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """The questions of these qids, and of those the first so many by pos."""
    chosen = qs.where(F.col("qid").isin(list(qids))) if qids is not None else qs
    return chosen.orderBy("pos").limit(first) if first is not None else chosen
