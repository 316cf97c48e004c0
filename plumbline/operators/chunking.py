"""Pages into overlapping token windows with deterministic ids, and the fingerprint of a corpus."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as T

CHUNKING_VERSION = "v1"
SIZE, OVERLAP = 500, 50
#: Texts of so many characters in all are given to a tokenizer at once.
GROUP_CHARS = 500_000


def windows(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of token arrays; the last one may be shorter, none lies wholly inside its predecessor. No tokens: none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    step = size - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / step)).cast("int")
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.slice(t, i * step + 1, size))

    # Bound to a name, as each window would split the whole text anew.
    return F.transform(F.array(tokens), cut)[0]


def split_pages(pages: DataFrame, tokens: Column | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """pages (source, page, page_content, ...) -> a row for each window: the other columns, page_content (the window) and
    pos (its place in the page). Windows never cross pages. tokens: another tokenizer's column."""
    keep = [c for c in pages.columns if c != "page_content"]
    if tokens is None:
        x = pages.select(*keep, F.posexplode(_white_windows(size, overlap)("page_content")).alias("pos", "w"))
        return x.select(*keep, F.col("w").alias("page_content"), "pos")
    return pages.select(*keep, F.posexplode(windows(tokens, size, overlap)).alias("pos", "w")).select(*keep, F.array_join("w", " ").alias("page_content"), "pos")


def _white_windows(size: int, overlap: int) -> Callable[[str], Column]:
    """windows() of T.white_tokens(), each as one string: text -> array of strings. Bytes are split, at the same ASCII
    white space, and joined in Arrow batches: the JVM takes several times as long over arrays of words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    step = size - overlap

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        ends, out = [0], []
        for t in texts.cast(pa.binary()).to_pylist():
            words = (t or b"").split()
            last = max(0, -(-(len(words) - size) // step)) if words else -1
            out += [b" ".join(words[at * step : at * step + size]) for at in range(last + 1)]
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.binary()).cast(pa.string()))

    return cut


def bpe_offsets(path: str) -> Callable[[list[str]], list[list[tuple[int, int]]]]:
    """For split_by_offsets(): where tokens of a vocabulary file of the `tokenizers` library stand in each text."""

    def of(texts: list[str]) -> list[list[tuple[int, int]]]:
        tokenizer = _tokenizer(path)
        return [e.offsets for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return of


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def split_by_offsets(pages: DataFrame, offsets: Callable[[list[str]], list[list[tuple[int, int]]]], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Like split_pages() with the tokens of a model's own vocabulary: each window is the text from its first token to its
    last, as it stands there. offsets: texts to the (start, end) of their tokens, a group of bounded size at a time. Only spans of
    characters come back from Python; texts are cut in the JVM."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    step = size - overlap

    @F.pandas_udf("array<struct<start:int,past:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for tokens in (found for group in _groups([t or "" for t in texts]) for found in offsets(group)):
            starts = range(0, max(0, -(-(len(tokens) - size) // step)) * step + 1, step) if tokens else ()
            out.append([{"start": tokens[i][0], "past": max(e for _, e in tokens[i : i + size])} for i in starts])
        return pd.Series(out, dtype=object)

    keep = [c for c in pages.columns if c != "page_content"]
    x = pages.select(*keep, "page_content", F.posexplode(spans("page_content")).alias("pos", "w"))
    return x.select(*keep, F.substring("page_content", F.col("w.start") + 1, F.col("w.past") - F.col("w.start")).alias("page_content"), "pos")


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """texts in groups of GROUP_CHARS, or of one longer text: a tokenizer holds some hundred bytes a token."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def assign_ids(chunks: DataFrame) -> DataFrame:
    """chunks (source, page, page_content, pos, ...) -> also chunk_id, arxiv_id, ordinal and text_sha8.

    ordinal counts from 0 within a paper and page in the order of (source, pos). Missing source or page: an error. Equal
    source names in different folders are one paper, as its id is the file's name."""
    need = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.raise_error(F.lit(f"a chunk lacks {c}")).cast("string")).otherwise(F.col(c).cast("string"))
    x = chunks.withColumn("arxiv_id", T.basename_stem(need("source"))).withColumn("page", need("page").cast("int"))
    x = x.withColumn("ordinal", (F.row_number().over(Window.partitionBy("arxiv_id", "page").orderBy("source", "pos")) - 1).cast("int"))
    return x.withColumn("chunk_id", T.make_chunk_id(F.col("arxiv_id"), F.col("page"), F.col("ordinal"))).withColumn("text_sha8", T.sha8(F.col("page_content"))).drop("pos")


def chunk(pages: DataFrame, **options) -> DataFrame:
    return assign_ids(split_pages(pages, **options))


def guard_unique(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """df; using it fails if a key occurs twice. One count over a window by key, no second pass."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("bigint")).otherwise(n)).where("_n = 1").drop("_n")


def fingerprint(papers: list[tuple[str, str | None]], version: str = CHUNKING_VERSION, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """Of the chunking and the frozen papers (arxiv_id, sha256): a list the size of a manifest."""
    payload = {"chunking_version": version, "chunk_size": size, "chunk_overlap": overlap, "papers": sorted((a, s or "") for a, s in papers)}
    return "sha256:" + hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id, neighbour_id: chunks of the same paper and page whose ordinals differ by one."""
    at = chunks.select("chunk_id", "arxiv_id", "page", "ordinal")
    other = at.select(F.col("chunk_id").alias("neighbour_id"), "arxiv_id", "page", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"))
    return at.join(other, ["arxiv_id", "page", "ordinal"]).select("chunk_id", "neighbour_id")


def browse(chunks: DataFrame, paper: str | None = None, page: int | None = None, chars: int = 320) -> DataFrame:
    """Previews in the numeric order of paper, page and ordinal."""
    at = T.parse_chunk_id(F.col("chunk_id"))
    x = chunks.withColumn("_at", at)
    if paper is not None:
        x = x.where(F.col("_at.arxiv_id") == paper)
    if page is not None:
        x = x.where(F.col("_at.page") == page)
    return x.orderBy("_at.arxiv_id", "_at.page", "_at.ordinal").select("chunk_id", T.preview(F.col("page_content"), chars).alias("preview"))


def paper_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("arxiv_id").agg(F.count("*").alias("n_chunks"))


def count_summary(chunks: DataFrame) -> DataFrame:
    return paper_counts(chunks).agg(F.count("*").alias("n_papers"), F.sum("n_chunks").alias("n_chunks"), F.avg("n_chunks").alias("mean_chunks"), F.min("n_chunks").alias("min_chunks"), F.max("n_chunks").alias("max_chunks"))
