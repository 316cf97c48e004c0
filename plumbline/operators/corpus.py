"""Corpus intake: candidates, citation edges, curation, manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.ranks import numbered
from plumbline.session import prepare


def references(items: Column) -> Column:
    """Sorted distinct arXiv ids of array<struct<externalIds:map<string,string>>>; null-safe."""
    ids = F.transform(F.coalesce(items, F.expr("array()").cast("array<struct<externalIds:map<string,string>>>")), lambda i: i["externalIds"]["ArXiv"])
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != ""))))


def annotate(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """candidates (arxiv_id, ...) with lookup (arxiv_id, citation_count, ref_arxiv_ids): s2_found tells whether it has one."""
    found = lookup.select("arxiv_id", "citation_count", "ref_arxiv_ids", F.lit(True).alias("s2_found"))
    x = candidates.drop("citation_count", "ref_arxiv_ids", "s2_found").join(found, "arxiv_id", "left")
    return x.withColumn("s2_found", F.coalesce("s2_found", F.lit(False))).withColumn("ref_arxiv_ids", F.coalesce("ref_arxiv_ids", F.expr("cast(array() as array<string>)")))


def recent(candidates: DataFrame, cutoff: Column, most: int | None = None) -> DataFrame:
    """Published at the cutoff or later; dates that don't parse pass. One row an id, the newest first."""
    at = F.try_to_timestamp(F.col("published"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    x = candidates.withColumn("_at", at).where(F.col("_at").isNull() | (F.col("_at") >= cutoff)).dropDuplicates(["arxiv_id"])
    return (x.orderBy(F.col("_at").desc_nulls_last(), "arxiv_id").limit(most) if most else x).drop("_at")


def cutoff(now: Column, years: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(365 * years))


def with_anchors(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """Anchors, then those found that are none."""
    prepare(anchors.sparkSession)
    return anchors.unionByName(found.join(anchors.select("arxiv_id"), "arxiv_id", "left_anti").select(*anchors.columns))


def edges(candidates: DataFrame) -> DataFrame:
    """citing, cited: distinct references inside the corpus, none to itself."""
    refs = candidates.select(F.col("arxiv_id").alias("citing"), F.explode("ref_arxiv_ids").alias("cited")).where("citing <> cited")
    return refs.join(candidates.select(F.col("arxiv_id").alias("cited")).distinct(), "cited", "left_semi").select("citing", "cited").distinct()


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """arxiv_id, degree: edges at either end; 0 without."""
    ends = links.select(F.explode(F.array("citing", "cited")).alias("arxiv_id")).groupBy("arxiv_id").agg(F.count("*").alias("degree"))
    return nodes.select("arxiv_id").join(ends, "arxiv_id", "left").select("arxiv_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolated(degree: DataFrame) -> DataFrame:
    return degree.agg(F.count_if(F.col("degree") == 0).alias("n_isolated"))


def curate(candidates: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by a table of ids."""
    return candidates.join(keep.select("arxiv_id"), "arxiv_id", "left_semi"), candidates.join(keep.select("arxiv_id"), "arxiv_id", "left_anti")


def induced(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are kept."""
    ids = kept.select("arxiv_id")
    return links.join(ids.withColumnRenamed("arxiv_id", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("arxiv_id", "cited"), "cited", "left_semi").select("citing", "cited")


def review(candidates: DataFrame, degree: DataFrame) -> DataFrame:
    """place, line: rows of a Markdown table, the most linked first, ties in the order of pos."""
    x = candidates.join(degree, "arxiv_id", "left")
    line = F.format_string("| %s | %s | %s | %d | %s |", "arxiv_id", "source", F.coalesce(F.substring("published", 1, 4), F.lit("")), F.coalesce("degree", F.lit(0)), "title")
    return numbered(x.select("degree", "pos", line.alias("line")), [F.col("degree").desc(), F.col("pos")]).select("place", "line")


def keep_set(*lists: DataFrame) -> DataFrame:
    """arxiv_id: everything that any of the lists keeps, once."""
    prepare(lists[0].sparkSession)
    return reduce(DataFrame.union, [x.select("arxiv_id") for x in lists]).where("arxiv_id is not null").distinct()


def fetch(papers: DataFrame, present: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """papers (arxiv_id, ...) and the files at hand (path, content) -> path, content, error for manifest(). What is there
    and not empty isn't fetched again; a failure is a row, not an exception. get: an id's file, called on executors."""
    have = present.where(F.coalesce(F.length("content"), F.lit(0)) > 0).select("path", "content", F.lit(None).cast("string").alias("error"))
    wanted = papers.select("arxiv_id").distinct().join(have.select(T.basename_stem(F.col("path")).alias("arxiv_id")).distinct(), "arxiv_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["arxiv_id"]:
                try:
                    rows.append((f"{i}.pdf", get(i), None))
                except Exception as e:  # whatever a download meets
                    rows.append((f"{i}.pdf", None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    prepare(papers.sparkSession)
    return have.unionByName(wanted.mapInPandas(run, "path string, content binary, error string"))


def manifest(papers: DataFrame, files: DataFrame) -> DataFrame:
    """papers (arxiv_id, ...) with files (path, content or null, error): status, sha256 and file_size_bytes. A failed
    download is a row, not an exception."""
    got = files.select(T.basename_stem(F.col("path")).alias("arxiv_id"), "content", "error")
    x = papers.join(got, "arxiv_id", "left")
    ok = F.col("content").isNotNull() & (F.length("content") > 0)
    return x.select(*papers.columns, F.when(ok, "ok").otherwise("download_failed").alias("status"), F.when(ok, F.sha2("content", 256)).alias("sha256"), F.when(ok, F.length("content").cast("long")).alias("file_size_bytes"), F.when(~ok, F.coalesce("error", F.lit("missing"))).alias("error"))


def manifest_totals(entries: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return entries.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.coalesce(F.sum(F.when(ok, F.col("file_size_bytes"))), F.lit(0)).alias("total_bytes"))
