"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, leanly, release, shingle_hashes, table, tune, unit, words
from .langid import held_out
from .ngrams import folded, grams

SIZES = (3, 4, 5)
_BITS = 20
_BUCKETS = 1 << _BITS
_BLOCKS = 16


@dataclass
class Model:
    """Sorted 32-bit n-gram hashes, the weight of each, and the intercept. seen: whether a bucket holds any of them."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(_BUCKETS, bool)
        self.seen[self.features >> np.uint32(32 - _BITS)] = True

    def found(self, text: str | None) -> np.ndarray:
        """Places in features of those that occur in the text."""
        points = folded(text or "")
        hits = []
        for n in SIZES:
            g = grams(points, n)
            hits.append(g[self.seen[g >> np.uint32(32 - _BITS)]])
        g = np.unique(np.concatenate(hits))
        at = np.searchsorted(self.features, g)
        inside = at < len(self.features)
        return at[inside][self.features[at[inside]] == g[inside]]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.found(text)].sum(), -40, 40))))


def _distinct(text: str | None) -> np.ndarray:
    points = folded(text or "")
    return np.unique(np.concatenate([grams(points, n) for n in SIZES]))


def log_count_ratio(with1: np.ndarray, with0: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Of the shares that a feature has of all occurrences of features in toxic and in other documents."""
    a, b = with1 + alpha, with0 + alpha
    return np.log(a / a.sum()) - np.log(b / b.sum())


def _signal(with1: np.ndarray, with0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far document frequencies lie from chance, in standard deviations."""
    p = (with1 + with0 + 0.5) / (n1 + n0 + 1)
    return np.abs(with1 - n1 * p) / np.sqrt(n1 * p * (1 - p) * n0 / max(1, n1 + n0) + 1)


def _train(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, base: float, rounds: int = 300, ridge: float = 4.0) -> tuple[np.ndarray, float]:
    """Logistic regression on present features scaled by their ratios, by accelerated gradient steps."""
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratio[at]
    w, b = np.zeros(len(ratio)), base
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, value * w[at], minlength=len(rows))
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.bincount(at, value * e[row], minlength=len(w)) + ridge * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - t / (rounds + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most: int = 24_000, features: int = 4096, least_docs: int = 5, least_signal: float = 4.5) -> Model:
    """Learns from docs (doc_id, text) with a label in labels (doc_id, toxic) whose doc_id isn't held out.

    The classifier is fitted on at most about `most` labelled documents, picked by hash of doc_id at one rate for all.
    Document frequencies by class of hashed n-grams are added up over tasks; the n-grams in the buckets that tell most
    are then counted one by one, and the `features` best become features: those whose frequencies by class lie at
    least least_signal standard deviations from chance, so that noise in labels finds none to fit. What reaches the driver is bounded by
    `most` and `features`. Conflicting labels of a doc_id: toxic wins. No label: no features, a score of 0.1 for all."""
    tune(docs.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out("doc_id"))
    n = marks.count()
    marks = marks.where(unit("doc_id", F.lit(3)) < most / n) if n > most else marks
    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", "text", "toxic").repartition(16).persist()  # marks: at most about `most` rows
    try:
        return _fit(some.join(F.broadcast(_first_copies(some)), "doc_id").select("text", "toxic"), features, least_docs, least_signal)
    finally:
        some.unpersist()


def _first_copies(some: DataFrame, keys: int = 4) -> DataFrame:
    """doc_id of sampled documents that share no minimum of their word-run hashes with an earlier one: many copies of one
    text with one label, right or wrong, would pass for evidence. At most about `most` short rows reach the driver."""
    mult = np.random.default_rng(5).integers(0, 1 << 32, keys, np.uint32) | np.uint32(1)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            g = [(shingle_hashes(np.array([known[w] for w in words(t)], np.uint64), 4) >> np.uint64(32)).astype(np.uint32) for t in b.column("text").to_pylist()]
            least = [[int((x * m).min()) << 2 | i for i, m in enumerate(mult)] if len(x) else [] for x in g]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "least"])

    seen: set[int] = set()
    first = []
    for r in sorted(some.select("doc_id", "text").mapInArrow(leanly(minima), "doc_id long, least array<long>").collect(), key=lambda r: r["doc_id"]):
        if seen.isdisjoint(r["least"]):
            first.append((r["doc_id"],))
        seen.update(r["least"])
    return some.sparkSession.createDataFrame(first, "doc_id long")


def _fit(some: DataFrame, features: int, least_docs: int, least_signal: float) -> Model:
    width = _BUCKETS // _BLOCKS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((2, _BUCKETS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                g = _distinct(text)
                total[toxic, np.unique(g >> np.uint32(32 - _BITS))] += 1
                docs[toxic] += 1
        parts = [total[:, i * width : (i + 1) * width].tobytes() for i in range(_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([docs[0]] * _BLOCKS), pa.array([docs[1]] * _BLOCKS)], names=["block", "counts", "n0", "n1"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["counts"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [total.astype(np.int32).tobytes()], "n0": [rows["n0"].sum()], "n1": [rows["n1"].sum()]})

    schema = "block int, counts binary, n0 long, n1 long"
    sums = sorted(some.mapInArrow(leanly(spread), schema).groupBy("block").applyInPandas(merge, schema).collect(), key=lambda r: r["block"])
    if not sums or not sums[0]["n0"] + sums[0]["n1"]:
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(0.1 / 0.9)))
    n0, n1 = sums[0]["n0"], sums[0]["n1"]
    base = float(np.log((n1 + 0.1) / (n0 + 0.9)))
    counts = np.concatenate([np.frombuffer(r["counts"], np.int32).reshape(2, width) for r in sums], axis=1)
    signal = np.where(counts.sum(0) >= least_docs, _signal(counts[1], counts[0], n1, n0), 0)
    telling = np.argsort(-signal, kind="stable")[: 2 * features]
    telling = np.sort(telling[signal[telling] >= least_signal])
    wanted = np.zeros(_BUCKETS, bool)
    wanted[telling] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[list, list] = ([], [])
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                g = _distinct(text)
                seen[toxic].append(g[wanted[g >> np.uint32(32 - _BITS)]])
        for toxic in (0, 1):
            if seen[toxic]:
                g, k = np.unique(np.concatenate(seen[toxic]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(k * (1 - toxic)), pa.array(k * toxic)], names=["gram", "with0", "with1"])

    each = some.mapInArrow(leanly(count), "gram long, with0 long, with1 long").groupBy("gram").agg(F.sum("with0").alias("with0"), F.sum("with1").alias("with1")).where(F.col("with0") + F.col("with1") >= least_docs)
    p = (F.col("with0") + F.col("with1") + 0.5) / F.lit(float(n0 + n1 + 1))
    score = F.abs(F.col("with1") - n1 * p) / F.sqrt(p * (1 - p) * F.lit(n1 * n0 / max(1, n0 + n1)) + 1)
    best = sorted(each.where(score >= least_signal).orderBy(score.desc(), "gram").limit(features).collect(), key=lambda r: r["gram"])
    with1, with0 = np.array([r["with1"] for r in best], float), np.array([r["with0"] for r in best], float)
    ratio = log_count_ratio(with1, with0) if best else np.empty(0)
    model = Model(np.array([r["gram"] for r in best], np.uint32), ratio, base)
    place = some.sparkSession.sparkContext.broadcast(model)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [place.value.found(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["toxic", "at"])

    rows = some.mapInArrow(leanly(present), "toxic int, at binary").collect()  # at most about `most` rows of a few features each
    weights, intercept = _train([np.frombuffer(r["at"], np.int32) for r in rows], np.array([r["toxic"] for r in rows], float), ratio, base)
    return Model(model.features, weights * ratio, float(intercept))


def rate(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to docs. Whole texts are read; null or empty text, or
    text without letters, gets the score of a text without features. Columns of those names are replaced."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
