"""BM25 as tables: postings, document lengths, term statistics, and batches of questions searched by one join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as T

K1, B = 1.2, 0.75
OKAPI_K1, EPSILON = 1.5, 0.25
VARIANTS = ("lucene", "okapi")
#: Scores are rounded before ranking: sums in another order differ in the last bits and would swap near ties.
DIGITS = 7
#: Questions of at most so many terms in all are broadcast to the postings.
BROADCAST_TERMS = 200_000
#: So many pairs of question and document are broadcast to be explained.
BROADCAST_PAIRS = 20_000
#: Up to so many matches of a question's term and a document are joined as rows.
JOINED_MATCHES = 5_000_000
#: Scores that a task holds at a time, documents times questions.
SCORES_AT_ONCE = 2_000_000
#: A term of so many questions is summed by a matrix product.
DENSE_TERM = 5
#: Saved postings lie in so many folders by hash of the term; a search reads those of the terms asked for.
BUCKETS = 16
#: Texts whose terms a task counts at a time.
TEXTS_AT_ONCE = 512


@dataclass
class Index:
    """postings (bucket, term, chunk_id, tf, dl), docs (chunk_id, dl), counts (term, df), stats (n_docs, avgdl; one row),
    texts (chunk_id, dl, terms, tfs): the postings again, by document.

    Built over a corpus, these are plans that tokenise it at each use; saved, tables that any variant can read."""

    postings: DataFrame
    docs: DataFrame
    counts: DataFrame
    stats: DataFrame
    texts: DataFrame
    k1: float = K1
    b: float = B
    variant: str = "lucene"
    epsilon: float = EPSILON
    bucketed: bool = True

    @property
    def terms(self) -> DataFrame:
        """term, df, idf."""
        df = self.counts.crossJoin(F.broadcast(self.stats.select("n_docs")))  # stats: one row
        n, f = F.col("n_docs").cast("double"), F.col("df").cast("double")
        if self.variant == "lucene":
            return df.select("term", "df", F.log(1 + (n - f + 0.5) / (f + 0.5)).alias("idf"))
        raw = df.select("term", "df", (F.log(n - f + 0.5) - F.log(f + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(self.epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))

    def save(self, path: str, bucketed: bool = True) -> Index:
        """The same index read from tables under path. The corpus is tokenised once. Unless bucketed, postings are read from
        texts, which saves their sort and a second copy; searches then go through all texts."""
        spark = self.stats.sparkSession
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        source = _over(spark.read.schema(TEXTS).parquet(f"{path}/texts"))
        source.docs.write.mode("overwrite").parquet(f"{path}/docs")
        if bucketed:
            source.postings.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        source.counts.write.mode("overwrite").parquet(f"{path}/terms")
        _stats(spark.read.schema(DOCS).parquet(f"{path}/docs")).write.mode("overwrite").parquet(f"{path}/stats")
        return Index.load(spark, path, self.k1, self.b, self.variant, self.epsilon, bucketed)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k1: float | None = None, b: float = B, variant: str = "lucene", epsilon: float = EPSILON, bucketed: bool = True) -> Index:
        read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
        postings = read(POSTINGS, "postings") if bucketed else _postings(read(TEXTS, "texts"))
        return cls(postings, read(DOCS, "docs"), read("term string, df long", "terms"), read("n_docs long, avgdl double", "stats"), read(TEXTS, "texts"), _k1(k1, variant), b, variant, epsilon, bucketed)


POSTINGS = "term string, chunk_id string, tf long, dl long, bucket int"
DOCS = "chunk_id string, dl long"
TEXTS = "chunk_id string, dl long, terms array<string>, tfs array<long>"


def _k1(k1: float | None, variant: str) -> float:
    if variant not in VARIANTS:
        raise ValueError(f"unknown idf variant {variant!r}; one of {VARIANTS}")
    return (OKAPI_K1 if variant == "okapi" else K1) if k1 is None else k1


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, tokens -> chunk_id, dl, distinct terms and how often each occurs. Counted here, as a size beside the tokens
    would have the JVM tokenise twice."""
    for b in batches:
        tokens = b.column("tokens")
        coded = pc.list_flatten(tokens).dictionary_encode()
        many = max(1, len(coded.dictionary))
        rows = np.repeat(np.arange(b.num_rows), _lengths(tokens))
        pair, tf = np.unique(rows * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = pa.array(np.searchsorted(pair // many, np.arange(b.num_rows + 1)), pa.int32())
        terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pair % many)).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pc.list_value_length(tokens).cast(pa.int64()), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["chunk_id", "dl", "terms", "tfs"])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, text -> chunk_id, dl, distinct terms and how often each occurs."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            b = batch.slice(at, TEXTS_AT_ONCE)
            texts = b.column("text").to_pylist()
            found = [T.term_counts(t or "") for t in texts]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            dl = pa.array([None if t is None else f.total() for t, f in zip(texts, found, strict=True)], pa.int64())
            terms = pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(found)), pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(f.values() for f in found)), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), dl, terms, tfs], names=["chunk_id", "dl", "terms", "tfs"])


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _postings(texts: DataFrame) -> DataFrame:
    each = texts.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return each.select(F.col("p.terms").alias("term"), "chunk_id", F.col("p.tfs").alias("tf"), "dl", _bucket(F.col("p.terms")).alias("bucket"))


def _over(texts: DataFrame, **options) -> Index:
    """texts (chunk_id, dl, terms, tfs) -> Index."""
    one = F.count(F.lit(1)).over(Window.partitionBy("chunk_id"))
    docs = chunks_once(texts.select("chunk_id", "dl", one.alias("_n")))
    postings = _postings(texts)
    return Index(postings, docs, _counts(texts), _stats(docs), texts, **options)


def build(chunks: DataFrame, k1: float | None = None, b: float = B, variant: str = "lucene", epsilon: float = EPSILON, tokens: Column | None = None) -> Index:
    """chunks (chunk_id, text, ...) -> Index. tokens: a column of term arrays, tokenize(text) by default.

    Documents without terms count in n_docs and avgdl. A repeated chunk_id is an error when the index is used or saved."""
    k1 = _k1(k1, variant)
    if tokens is None:  # counted where it is tokenised: the JVM's regular expressions take several times as long
        texts = chunks.select("chunk_id", "text").mapInArrow(_count_texts, TEXTS)
    else:
        texts = chunks.select("chunk_id", tokens.alias("tokens")).mapInArrow(_count_terms, TEXTS)
    return _over(texts, k1=k1, b=b, variant=variant, epsilon=epsilon)


def chunks_once(docs: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("duplicate chunk_id: "), F.col("chunk_id"))).cast("bigint")
    return docs.withColumn("_n", F.when(F.col("_n") > 1, bad).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def index_stats(index: Index) -> DataFrame:
    return index.stats.crossJoin(index.counts.agg(F.count("*").alias("vocabulary"))).select(
        "n_docs", F.round("avgdl", 3).alias("avgdl"), "vocabulary", F.lit(index.k1).alias("k1"), F.lit(index.b).alias("b"), F.lit(index.variant).alias("idf_variant"), F.lit(T.TOKENIZATION_VERSION).alias("tokenization_version")
    )


def _asked(questions: DataFrame) -> DataFrame:
    """qid, term, qtf."""
    return questions.select("qid", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _term_value(index: Index) -> Column:
    tf, norm = F.col("tf").cast("double"), 1 - index.b + index.b * F.col("dl") / F.col("avgdl")
    return F.col("qtf") * F.col("idf") * tf * (index.k1 + 1) / (tf + index.k1 * norm)


def contributions(index: Index, questions: DataFrame) -> DataFrame:
    """questions (qid, text) -> qid, chunk_id, term, value: what each term adds to each document that holds it.

    A term that a question repeats counts as often; it is joined once, with its number. Terms that the index lacks add
    nothing. Saved postings are read from the buckets of the terms asked for alone."""
    asked = _asked(questions).withColumn("bucket", _bucket(F.col("term")))
    n, buckets = asked.agg(F.count("*"), F.collect_set("bucket")).first()  # BUCKETS numbers at most
    held = F.broadcast if n <= BROADCAST_TERMS else lambda df: df
    asked = index.terms.select("term", "idf").join(held(asked), "term")  # no more rows than asked
    x = index.postings.where(F.col("bucket").isin(buckets)).join(held(asked), ["bucket", "term"]).crossJoin(F.broadcast(index.stats.select("avgdl")))
    return x.select("qid", "chunk_id", "term", _term_value(index).alias("value"))


def score_all(index: Index, questions: DataFrame) -> DataFrame:
    """qid, chunk_id, score of every document that holds a term of the question."""
    return contributions(index, questions).groupBy("qid", "chunk_id").agg(F.round(F.sum("value"), DIGITS).alias("score"))


def search(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """qid, rank (from 1), chunk_id, score: the k best, ties by chunk_id.

    Few matches come from a join of the postings. Where frequent terms make many, a row for each would be shuffled; the
    questions travel to the documents instead, and of each task only every question's k best go on."""
    scores = _best_of_texts(index, questions, k)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id")
    return (score_all(index, questions) if scores is None else scores).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def _best_of_texts(index: Index, questions: DataFrame, k: int) -> DataFrame | None:
    """qid, chunk_id, score of at least every question's k best documents; None if a join serves better: for few matches,
    or for more terms than a task may hold."""
    asked = _asked(questions)
    if asked.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    held = index.terms.join(F.broadcast(asked), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df").toArrow()  # no more rows than asked
    if not held.num_rows or index.bucketed and pc.sum(held.column("df")).as_py() <= JOINED_MATCHES:
        return None
    asking, avgdl, k1, b = _Questions(held), index.stats.first()["avgdl"], index.k1, index.b

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(asking, k)
        for batch in batches:
            step = max(1, SCORES_AT_ONCE // len(asking.qids))
            for at in range(0, batch.num_rows, step):
                best.meet(batch.slice(at, step), avgdl, k1, b)
        yield from best.table()

    kind = {f.name: f.dataType.simpleString() for f in (questions.schema["qid"], index.texts.schema["chunk_id"])}
    return index.texts.mapInArrow(meet, f"qid {kind['qid']}, chunk_id {kind['chunk_id']}, score double")


class _Questions:
    """Questions as weights of their terms: those of many questions as rows of a matrix, the others as lists."""

    def __init__(self, held: pa.Table):
        qids, terms = (held.column(c).combine_chunks().dictionary_encode() for c in ("qid", "term"))
        self.qids, self.terms = qids.dictionary, terms.dictionary
        q, t = qids.indices.to_numpy(zero_copy_only=False), terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(t, kind="stable")
        self.q, self.weight = q[order].astype(np.int64), held.column("weight").to_numpy()[order]
        self.starts = np.searchsorted(t[order], np.arange(len(self.terms) + 1))
        shared = np.flatnonzero(np.diff(self.starts) >= DENSE_TERM)[: max(1, SCORES_AT_ONCE // len(self.qids))]
        self.row = np.full(len(self.terms), -1)
        self.row[shared] = np.arange(len(shared))
        self.matrix = np.zeros((len(shared), len(self.qids)))
        for i, term in enumerate(shared):
            at = slice(self.starts[term], self.starts[term + 1])
            self.matrix[i, self.q[at]] = self.weight[at]
        self.asks = np.zeros_like(self.matrix)
        for i, term in enumerate(shared):
            self.asks[i, self.q[self.starts[term] : self.starts[term + 1]]] = 1.0

    def totals(self, n: int, rows: np.ndarray, terms: np.ndarray, value: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """(n documents, questions): sums of value times weight over the terms that each holds."""
        row = self.row[terms]
        dense = np.zeros((n, len(matrix)))
        dense[rows[row >= 0], row[row >= 0]] = value[row >= 0]
        rows, terms, value = rows[row < 0], terms[row < 0], value[row < 0]
        many = self.starts[terms + 1] - self.starts[terms]
        each = np.repeat(np.arange(len(terms)), many)
        at = np.arange(len(each)) + np.repeat(self.starts[terms] - (np.cumsum(many) - many), many)
        size = len(self.qids)
        return dense @ matrix + np.bincount(rows[each] * size + self.q[at], value[each] * weight[at], n * size).reshape(n, size)


class _Best:
    """The k best documents of each question so far, ties by id."""

    def __init__(self, asking: _Questions, k: int):
        self.asking, self.k = asking, k
        self.bar = np.full(len(asking.qids), -np.inf)
        self.found: pa.Table | None = None

    def meet(self, texts: pa.RecordBatch, avgdl: float, k1: float, b: float) -> None:
        ask, n = self.asking, texts.num_rows
        term = pc.fill_null(pc.index_in(pc.list_flatten(texts.column("terms")), value_set=ask.terms), -1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), _lengths(texts.column("terms")))[term >= 0]
        tf = pc.list_flatten(texts.column("tfs")).to_numpy(zero_copy_only=False)[term >= 0].astype(float)
        term = term[term >= 0]
        dl = texts.column("dl").to_numpy(zero_copy_only=False)[rows]
        value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        score = ask.totals(n, rows, term, value, ask.weight, ask.matrix)
        # A weight may be 0 or less (okapi); then a score doesn't tell whether a document holds a term.
        holds = score > 0 if (ask.weight > 0).all() else ask.totals(n, rows, term, np.ones(len(term)), np.ones(len(ask.weight)), ask.asks) > 0.5
        score = np.where(holds, np.round(score, DIGITS) + 0.0, -np.inf)
        if n > self.k:
            self.bar = np.maximum(self.bar, np.partition(score, n - self.k, axis=0)[n - self.k])
        which, question = np.nonzero(holds & (score >= self.bar))
        if not len(which):
            return
        new = pa.table({"q": question, "score": score[which, question], "chunk_id": texts.column("chunk_id").take(pa.array(which))})
        found = new if self.found is None else pa.concat_tables([self.found, new])
        found = found.take(pc.sort_indices(found, sort_keys=[("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
        q = found.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bar[q[last]] = np.maximum(self.bar[q[last]], found.column("score").to_numpy()[last])
        self.found = found.filter(pa.array(place < self.k)).combine_chunks()

    def table(self) -> Iterator[pa.RecordBatch]:
        if self.found is not None:
            out = pa.table({"qid": self.asking.qids.take(self.found.column("q").combine_chunks()), "chunk_id": self.found.column("chunk_id"), "score": self.found.column("score")})
            yield from out.to_batches()


def search_one(index: Index, spark: SparkSession, text: str, k: int) -> DataFrame:
    """rank, chunk_id, score of a single question: one ordered limit instead of a window."""
    best = score_all(index, spark.createDataFrame([("q", text)], "qid string, text string")).orderBy(F.col("score").desc(), "chunk_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id")).alias("rank"), "chunk_id", "score")


def explain(index: Index, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (qid, chunk_id) -> qid, chunk_id, term, value, largest first; values sum to the score. A chunk_id that the
    index lacks is an error.

    Up to BROADCAST_PAIRS pairs meet their documents' terms alone; more meet all contributions in a join."""
    few = pairs.select("qid", "chunk_id").limit(BROADCAST_PAIRS + 1).toArrow()
    small = few.num_rows <= BROADCAST_PAIRS
    pairs = index.stats.sparkSession.createDataFrame(few, pairs.select("qid", "chunk_id").schema) if small else pairs
    docs = index.docs.join(F.broadcast(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi") if small else index.docs
    known = pairs.join(docs.select("chunk_id", F.lit(True).alias("_known")), "chunk_id", "left")
    known = known.where(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown chunk_id: "), F.col("chunk_id"))).cast("boolean")).otherwise(True)).select("qid", "chunk_id")
    if small:
        held = index.texts.join(F.broadcast(known), "chunk_id").select("qid", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("qid", "chunk_id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        x = held.join(_asked(questions), ["qid", "term"]).join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
        x = x.select("qid", "chunk_id", "term", _term_value(index).alias("value")).where("value <> 0")
    else:
        x = contributions(index, questions).where("value <> 0").join(known, ["qid", "chunk_id"])
    return x.orderBy("qid", "chunk_id", F.col("value").desc(), "term")
