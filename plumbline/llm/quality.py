"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, leanly, release, small, table, tune, unit, word_hashes
from .langid import held_out

#: No probability comes nearer to 0 or 1 than this.
EDGE = 1e-4
#: Words are told apart by so many buckets of their hash.
BUCKETS = 1 << 16


def features(text: Column) -> list[Column]:
    """Shape of a text; ratios are 0 for null or empty text."""
    t = F.coalesce(text, F.lit(""))
    chars, n = F.char_length(t), F.regexp_count(t, F.lit(WORD))
    share = lambda count, of: F.when(of > 0, count / of).otherwise(0.0)
    without = lambda what: chars - F.char_length(F.translate(t, what, ""))
    lines = F.split(t, "\n")
    return [
        F.log1p(n.cast("double")),
        share(chars.cast("double"), n) / 10,
        share(without("|"), n),
        share(without("!?"), n),
        share(without("#$%&*@^~_=<>{}[]\\"), n),
        share(without("0123456789"), chars),
        share(without(".,;:"), n),
        share(F.char_length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")), chars),
        share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        share(F.regexp_count(t, F.lit(r"(?<!\S)(\S++)\s++(?=\1(?!\S))")), n),
        F.when(n < 8, 1.0).otherwise(0.0),
    ]


def _word_buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's distinct words, by hash."""
    return np.unique(word_hashes(text) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _mean_ratio(ratios: np.ndarray, at: np.ndarray) -> float:
    return float(ratios[at].mean()) if len(at) else 0.0


@dataclass
class Model:
    """Logistic weights over features() and one feature more: the mean of `ratios`, log ratios of how much likelier good
    documents hold a word than bad ones, over a document's distinct words."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray

    def probability(self, text: Column) -> Column:
        ratios = self.ratios

        @F.pandas_udf("double")
        def lexical(texts: pd.Series) -> pd.Series:
            release()
            return pd.Series([_mean_ratio(ratios, _word_buckets(t)) for t in texts], dtype=float)

        z = F.lit(float(self.weights[0]))
        for f, m, s, w in zip([*features(text), lexical(text)], self.mean, self.scale, self.weights[1:], strict=True):
            z = z + F.least(F.lit(30.0), F.greatest(F.lit(-30.0), (f - F.lit(float(m))) / F.lit(float(s)))) * F.lit(float(w))
        return 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))


def log_ratios(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Of numbers of documents that hold each word, each with half a document more."""
    return np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))


def _word_counts(rows: DataFrame) -> np.ndarray:
    """rows (fold, y, text) -> [fold, y, bucket]: how many documents hold a word of the bucket; the last entry: how many
    there are. A row a fold, label and bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS + 1), np.int64)
        for b in batches:
            for fold, y, t in zip(b.column("fold").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                total[fold, y, _word_buckets(t)] += 1
                total[fold, y, BUCKETS] += 1
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in at] + [pa.array(total[at])], names=["fold", "y", "bucket", "n"])

    out = np.zeros((2, 2, BUCKETS + 1))
    for r in rows.select("fold", "y", "text").mapInArrow(leanly(count), "fold int, y int, bucket int, n long").groupBy("fold", "y", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["fold"], r["y"], r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 24_000, ridge: float = 1.0) -> Model:
    """Learns `quality` from at most about `most` labelled documents that aren't held out, picked by hash of doc_id at one
    rate for all: log ratios of words, then a logistic regression on shape and words. For the regression each half of
    the documents takes the ratios of the other half, so that no document speaks for itself. Conflicting labels: the
    better. No labels: probability 0.5 for all."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality-fit")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y")).where(~held_out("doc_id"))
    n = marks.count()
    marks = marks.where(unit("doc_id", F.lit(4)) < most / n) if n > most else marks
    fold = (unit("doc_id", F.lit(6)) * 2).cast("int").alias("fold")
    some = scratch.save(docs.where("doc_id is not null").join(F.broadcast(marks), "doc_id").select(fold, "y", "text", F.array(*features(F.col("text"))).alias("x")))  # about `most` documents
    size = len(features(F.lit(""))) + 1
    counts = _word_counts(some)
    ratios = lambda c: log_ratios(c[1, :-1], c[0, :-1], c[1, -1], c[0, -1])
    halves, whole = [ratios(counts[1]), ratios(counts[0])], ratios(counts.sum(0))

    @F.pandas_udf("double")
    def lexical(folds: pd.Series, texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([_mean_ratio(halves[f], _word_buckets(t)) for f, t in zip(folds, texts, strict=True)], dtype=float)

    rows = some.select("y", "x", lexical("fold", "text").alias("words")).collect()  # about `most` short rows
    scratch.close()
    if not rows:
        return Model(np.zeros(size), np.ones(size), np.zeros(size + 1), np.zeros(BUCKETS))
    x, y = np.array([[*r["x"], r["words"]] for r in rows], float), np.array([r["y"] for r in rows], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -30, 30)])
    w = np.zeros(size + 1)
    keep = np.diag([1e-3, *[ridge] * size])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
    return Model(mean, scale, w, whole)


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> float:
    """How many documents a prior counts as: by moments, from how far groups' means lie apart beyond chance."""
    spread, chance, n = groups.where("n > 1").agg(F.avg(F.pow(F.col("s") / F.col("n") - F.col(mean), 2)), F.avg(F.col(mean) * (1 - F.col(mean)) / F.col("n")), F.count("*")).first()
    if not n or spread is None:
        return 10.0
    beyond = max(spread - chance, 1e-6)
    base = groups.agg(F.avg(F.col(mean) * (1 - F.col(mean)))).first()[0]
    return float(min(1e4, max(2.0, base / beyond - 1)))


def host_of(source: Column) -> Column:
    """Of a URL its host; else the source up to its first slash."""
    return F.lower(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def path_of(source: Column) -> Column:
    """The first two path segments of a URL, or of what stands behind a source's first slash; empty without any."""
    path = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/+([^?#]*)", 1)
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, 2), "/")


def judge(docs: DataFrame, model: Model, threshold: float = 0.5, site_weight: float = 0.5) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, host, path, evidence (the document's own probability of good quality),
    host_posterior, path_posterior, score and kept (score >= threshold).

    A host's posterior mean starts from the global mean, a path's from its host's; sparse ones stay near it, and a path
    that is all of its host has its host's. The document itself is left out of both. score adds to the evidence's log
    odds site_weight times the path posterior's log odds against the global mean. Null source: an own host. Null or
    empty text: judged by its shape like any other. Null doc_id: judged like any other. Repeated rows count as often as
    they occur. No rows: no rows."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    base = scratch.save(docs.select("doc_id", host_of(F.col("source")).alias("host"), path_of(F.coalesce("source", F.lit(""))).alias("path"), model.probability(F.col("text")).alias("evidence")))
    paths = scratch.save(base.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), narrow=True)
    total, n = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = min(1 - EDGE, max(EDGE, (total or 0.0) / n)) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("prior", F.lit(mean))
    k = _strength(hosts, "prior")
    hosts = hosts.withColumn("mu", (k * F.col("prior") + F.col("s")) / (k + F.col("n")))
    hosts = scratch.save(hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"), "mu"), narrow=True)
    paths = paths.join(small(hosts, 96), F.col("host").eqNullSafe(F.col("h")))
    j = _strength(paths.where("n < hn").select("n", "s", F.col("mu").alias("prior")), "prior")
    sites = scratch.save(paths.select("h", F.col("path").alias("p"), "hn", "hs", F.col("n").alias("pn"), F.col("s").alias("ps")), narrow=True)
    x = base.join(small(sites, 128), F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")))
    others = lambda s, m, prior, strength: (strength * prior + F.col(s) - F.col("evidence")) / (strength + F.col(m) - 1)
    x = x.withColumn("host_posterior", others("hs", "hn", F.lit(mean), k))
    x = x.withColumn("path_posterior", F.when(F.col("pn") == F.col("hn"), F.col("host_posterior")).otherwise(others("ps", "pn", F.col("host_posterior"), j)))
    odds = _logit(F.col("evidence")) + site_weight * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
    x = x.withColumn("score", 1 / (1 + F.exp(-odds)))
    return x.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
