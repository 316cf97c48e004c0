"""Language ID by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import leanly, release, table, tune, unit
from .ngrams import folded, grams

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
UNKNOWN = "und"


@dataclass
class Model:
    """languages, and log p(bucket | language) as (languages, BUCKETS)."""

    languages: list[str]
    log_p: np.ndarray


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs. Empty if it has no letter."""
    points = folded(text or "")
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.concatenate([grams(points, n) for n in SIZES]) & np.uint32(BUCKETS - 1)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def held_out(doc_id) -> F.Column:
    """Whether labels of a row must not be learned from; a row without a doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, most: int = 24_000, alpha: float = 0.5, languages: int = 500) -> Model:
    """Learns from docs (doc_id, text, lang) with a language whose doc_id isn't held out.

    n-gram counts come from at most about `most` documents, picked by hash of doc_id at one rate for all; the table of
    counts is `languages` x BUCKETS at most, whatever the corpus's size (more languages: an error). Each task adds up
    counts of its documents; grouped sums of arrays follow."""
    tune(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False))).select("doc_id", "text", "lang")
    n = known.count()
    some = known.where(unit("doc_id", F.lit(7)) < most / n) if n > most else known

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                at, k = _counts(text)
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += k
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "counts": [total.tobytes()]})

    parts = some.select("lang", "text").repartition(16).mapInArrow(leanly(add), "lang string, counts binary")  # 16 tasks: as many partial sums a language
    sums = parts.groupBy("lang").applyInPandas(merge, "lang string, counts binary").limit(languages + 1).collect()
    if len(sums) > languages:
        raise ValueError(f"more than {languages} languages")
    sums.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in sums], float).reshape(len(sums), BUCKETS) + alpha
    return Model([r["lang"] for r in sums], np.log(counts / counts.sum(1, keepdims=True)) if sums else counts)


def proportions(log_p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """EM for the mixture weights of languages in a text. log_p: (languages, grams), n: counts. Also the log-likelihood."""
    top = log_p.max(0)
    p = np.exp(log_p - top)
    w = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds if len(p) > 1 else 0):
        joint = w[:, None] * p
        w = (joint * (n / joint.sum(0))).sum(1) / total
    return w, float((n * (np.log(w @ p) + top)).sum())


def infer(model: Model, at: np.ndarray, n: np.ndarray, penalty: float = 3.0) -> dict[str, float]:
    """{language: proportion} of a text, the largest first.

    Starts from the likeliest language and adds, each time, the one whose mixture with those chosen gains most, while
    the gain exceeds penalty * log(number of n-grams) / 2 + 1: a penalised likelihood."""
    log_p = model.log_p[:, at]
    single = log_p @ n
    chosen, best = [int(single.argmax())], float(single.max())
    weights = np.ones(1)
    cost = penalty * np.log(max(2, n.sum())) / 2 + 1
    # A language can gain at most what its better n-grams would, were they all its own.
    while len(chosen) < len(model.languages):
        bound = (n * np.maximum(0, log_p - log_p[chosen].max(0))).sum(1)
        tries = []
        for k in np.flatnonzero(bound > cost):
            if k not in chosen:
                w, score = proportions(log_p[[*chosen, k]], n)
                tries.append((score, int(k), w))
        if not tries:
            break
        score, k, w = max(tries, key=lambda t: (t[0], -t[1]))
        if score - best <= cost or w.min() < 0.02:
            break
        chosen, best, weights = [*chosen, k], score, w
    order = sorted(range(len(chosen)), key=lambda i: (-weights[i], model.languages[chosen[i]]))
    return {model.languages[chosen[i]]: float(weights[i]) for i in order}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (its proportion) and languages (map of all chosen ones) to docs.

    Null text or text without letters: lang_pred `und`, score 0, no languages; all texts if the model has learned
    none. Every text is read whole. Columns of those names are replaced."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS doubles: its size is fixed

    @F.pandas_udf("lang_pred string, score double, languages map<string,double>")
    def guess(texts: pd.Series) -> pd.DataFrame:
        release()
        m = shared.value
        out = []
        for t in texts:
            at, n = _counts(t)
            found = infer(m, at, n) if len(at) and m.languages else {}
            first = next(iter(found), UNKNOWN)
            out.append((first, min(1.0, found.get(first, 0.0)), found))
        return pd.DataFrame(out, columns=["lang_pred", "score", "languages"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    return docs.select(*keep, guess("text").alias("_g")).select(*keep, "_g.lang_pred", "_g.score", "_g.languages")


def known_share(model: Model, at: np.ndarray, n: np.ndarray, penalty: float = 3.0) -> float:
    """How much of a text its languages make up together, beside unknown text, in which all buckets are as likely.

    1 unless unknown text adds more than a language must, see infer."""
    languages = infer(model, at, n, penalty)
    weights = np.array(list(languages.values()))
    log_p = model.log_p[[model.languages.index(k) for k in languages]][:, at]
    top = log_p.max(0)
    mixed = np.log(np.maximum(weights, 1e-300) @ np.exp(log_p - top)) + top
    w, score = proportions(np.stack([mixed, np.full(len(at), -np.log(BUCKETS))]), n)
    return float(w[0]) if score - float(mixed @ n) > penalty * np.log(max(2, n.sum())) / 2 + 1 else 1.0


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents of whose text known languages together make up at least `least`; columns stay.

    Null text or text without letters goes; all texts if the model has learned no language."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS doubles: its size is fixed

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        release()
        m = shared.value
        return pd.Series([known_share(m, *c) if len(c[0]) and m.languages else -1.0 for c in map(_counts, texts)], dtype=float)

    return docs.where(share("text") >= F.lit(float(least)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "languages")
