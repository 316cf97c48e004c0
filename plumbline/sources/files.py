"""Files in and out: uploads, question sets, runs, feeds, manifests, chat exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T

MOST_BYTES = 200 * 1024 * 1024
PAGE = "source string, page int, page_content string"
FEED = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "primary_category struct<_term:string>, link array<struct<_title:string,_href:string>>"
)


def uploads(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, content of files in the order of their paths; others than .pdf (case counts) or too long: an error."""
    x = spark.read.format("binaryFile").load(pattern).select("path", "length", "content")
    bad = F.when(~F.col("path").endswith(".pdf"), F.raise_error(F.concat(F.lit("not a .pdf file: "), "path")).cast("boolean")).when(F.col("length") > MOST_BYTES, F.raise_error(F.concat(F.lit("larger than 200 MB: "), "path")).cast("boolean")).otherwise(True)
    return x.where(bad).orderBy("path")


def pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """source, page (from 0), page_content of files (path, content). reader gives a file's page texts; no PDF library is
    bundled, so it is passed in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                texts = reader(bytes(content))
                yield pd.DataFrame({"source": path, "page": range(len(texts)), "page_content": texts})

    return files.select("path", "content").mapInPandas(run, PAGE)


def read_feed(spark: SparkSession, path: str, source: str = "arxiv_search") -> DataFrame:
    """Candidates of an Atom feed."""
    x = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(FEED).load(path)
    clean = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    aid = T.paper_id(F.col("id"))
    pdf = F.get(F.filter("link", lambda i: i["_title"] == "pdf"), F.lit(0))["_href"]
    return x.select(
        aid.alias("arxiv_id"), clean(F.col("title")).alias("title"), clean(F.col("summary")).alias("summary"), "published",
        F.transform("author", lambda a: a["name"]).alias("authors"), F.coalesce("primary_category._term", F.lit("")).alias("primary_category"),
        F.coalesce(F.nullif(pdf, F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), aid)).alias("pdf_url"), F.lit(source).alias("source"),
    )


def save_upload(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Writes an uploaded file to the landing folder, whole or not at all, and gives its path; others than .pdf (case
    counts), too long ones and names with folders: an error."""
    if not name.endswith(".pdf") or "/" in name or "\\" in name:
        raise ValueError(f"not a .pdf file: {name}")
    if len(data) > MOST_BYTES:
        raise ValueError(f"larger than 200 MB: {name}")
    fs, path = _fs(spark, folder)
    part, whole = path(f"{folder}/.{name}.part"), path(f"{folder}/{name}")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(whole, False)
    fs.rename(part, whole)
    return f"{folder}/{name}"


def _fs(spark: SparkSession, where: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], most: int, page: int = 50, cutoff: str | None = None) -> DataFrame:
    """Entries (arxiv_id, published, body as JSON) of a paged service, at most `most` by their order there, one an id: the
    first. fetch(start, size) gives a page; each page is a task's work, and pages behind the last are empty. cutoff:
    entries published before it go; ISO dates compare as text, and those that are no dates stay."""
    starts = spark.range(0, max(most, 0), page, numPartitions=max(1, -(-most // page)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["id"].tolist():
                got = fetch(start, min(page, most - start))
                yield pd.DataFrame([(start + i, e["arxiv_id"], e.get("published"), json.dumps(e, sort_keys=True)) for i, e in enumerate(got)], columns=["pos", "arxiv_id", "published", "body"])

    x = starts.mapInPandas(run, "pos long, arxiv_id string, published string, body string")
    first = x.groupBy("arxiv_id").agg(F.min_by(F.struct("pos", "published", "body"), "pos").alias("e")).select("e.pos", "arxiv_id", "e.published", "e.body")
    dated = F.coalesce(F.col("published").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
    return first if cutoff is None else first.where(~dated | (F.col("published") >= cutoff))


def lookup(ids: DataFrame, post: Callable[[list[str]], list[dict | None] | None], size: int = 50, tries: int = 5, wait: Callable[[int], None] | None = None) -> DataFrame:
    """ids (arxiv_id) -> arxiv_id, found, body (JSON): batches posted from the executors. post answers in the order asked,
    None for a miss, or None altogether if it should be asked again; after `tries` the whole batch counts as missed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b["arxiv_id"].tolist()
            for at in range(0, len(asked), size):
                some, got = asked[at : at + size], None
                for turn in range(tries):
                    got = post(some)
                    if got is not None:
                        break
                    if wait:
                        wait(turn)
                got = got or [None] * len(some)
                yield pd.DataFrame({"arxiv_id": some, "found": [g is not None for g in got], "body": [None if g is None else json.dumps(g) for g in got]})

    return ids.select("arxiv_id").mapInPandas(run, "arxiv_id string, found boolean, body string")


def write_run(scores: DataFrame, summary: DataFrame, meta: dict, path: str) -> None:
    """per_question and summary as JSON lines, run_meta as one row. Coverage ranks that are never reached stay null."""
    scores.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/per_question")
    summary.write.mode("overwrite").json(f"{path}/summary")
    scores.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run_meta")


def read_run(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A run's questions, one row a qid: its last line, by file and place; none is an error. Fields that older runs lack
    read as null."""
    x = (spark.read.schema(schema) if schema else spark.read).json(f"{path}/per_question")
    at = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    last = x.select("*", at.alias("_at")).groupBy("qid").agg(F.max_by(F.struct(*x.columns), "_at").alias("_r")).select("_r.*")
    if last.isEmpty():
        raise ValueError(f"no questions in {path}")
    return last


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document: an ingest manifest, a sweep's results, a run's meta. Written aside, then moved."""
    fs, at = _fs(spark, path)
    out = fs.create(at(f"{path}.part"), True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(at(path), False)
    fs.rename(at(f"{path}.part"), at(path))


def read_json(spark: SparkSession, path: str) -> dict | None:
    """None if there is no such file."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, or of a JSON object: manifests, candidates, drafts. Fields that it lacks read as null."""
    return spark.read.schema(schema).json(path, multiLine=True)


CANDIDATES = "arxiv_id string, title string, summary string, published string, authors array<string>, primary_category string, pdf_url string, source string, citation_count long, ref_arxiv_ids array<string>, s2_found boolean"
MANIFEST = "generated_at string, papers array<struct<arxiv_id:string,title:string,status:string,sha256:string,file_size_bytes:long,error:string>>"


def read_meta(spark: SparkSession, path: str) -> dict:
    """A sidecar's contents; none: empty."""
    try:
        rows = spark.read.text(f"{path}/run_meta").limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads(rows[0]["value"]) if rows else {}


def write_chat(history: DataFrame, path: str) -> None:
    """Six columns of CSV with a header."""
    cols = ["question", "answer", "provider", "model", F.array_join("pdf_names", ", ").alias("pdf_names"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")]
    history.orderBy("ts").select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (place, line) of a report in order."""
    lines.orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(path)
