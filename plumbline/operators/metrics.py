"""Scores of rankings against groups of equivalent relevant items, all from one number a group: its coverage rank."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import discount
from plumbline.operators.fusion import first_places
from plumbline.session import prepare

RR_CAP = 50
KS = (3, 5, 10)
STRATA = ("any_of", "all_required")
REPORTED = {"mrr": "rr", "recall_at_5": "recall_at_5", "sufficiency_at_5": "sufficiency_at_5", "ndcg_at_10": "ndcg_at_10"}
PRIMARY = "ndcg_at_10"
EPS = 1e-9
FIRES, STAYS, UNUSABLE = "fires", "stays", "unusable"
#: Draws that bootstrap() holds at a time.
DRAWS_AT_ONCE = 2_000_000
#: Iterations of the hashed bootstrap that go to a task together.
TURNS = 100


def check_groups(gold: DataFrame) -> DataFrame:
    """gold (qid, group_idx, chunk_id); using the result fails if a chunk is in two groups of a question, or null (an
    empty group)."""
    many = gold.groupBy("qid", "chunk_id").agg(F.countDistinct("group_idx").alias("_g"))
    bad = many.where((F.col("_g") > 1) | F.col("chunk_id").isNull()).select("qid", "chunk_id", F.lit(True).alias("_bad"))
    x = gold.join(bad, [gold.qid.eqNullSafe(bad.qid), gold.chunk_id.eqNullSafe(bad.chunk_id)], "left").select(gold["*"], "_bad")
    return x.where(F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("groups must be non-empty and disjoint: "), F.coalesce("qid", F.lit("NULL")))).cast("boolean")).otherwise(True)).drop("_bad")


def coverage(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    """gold (qid, semantics, group_idx, chunk_id), ranking (qid, pos, chunk_id) -> qid, semantics, group_idx, c: the best
    place of any member once repeats are dropped; null if none is ranked."""
    place = first_places(ranking, ["qid"]).select("qid", "chunk_id", "rank")
    return gold.join(place, ["qid", "chunk_id"], "left").groupBy("qid", "semantics", "group_idx").agg(F.min("rank").alias("c"))


def ideal(n: Column, k: int) -> Column:
    """Sum of the first min(n, k) discounts."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + discount(r))


def score_questions(covered: DataFrame, ks: Sequence[int] = KS, cap: int | None = RR_CAP) -> DataFrame:
    """coverage() -> a row a question: n_groups, coverage_ranks, rr (of the last group covered), rr_mean_groups, rr_first,
    recall_at_k, sufficiency_at_k and ndcg_at_k. One grouping computes all."""
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    n = F.count("*")
    inside = F.col("c").isNotNull() & (F.col("c") <= F.lit(cap)) if cap is not None else F.col("c").isNotNull()
    inverse = F.when(inside, 1 / F.col("c"))
    at = lambda k: F.count_if(F.col("c") <= k)
    aggregates = [
        n.alias("n_groups"),
        F.transform(F.array_sort(F.collect_list(F.struct("group_idx", F.col("c").cast("double").alias("c")))), lambda e: e["c"]).alias("coverage_ranks"),
        F.when(F.count_if(inside) == n, F.min(inverse)).otherwise(0.0).alias("rr"),
        (F.coalesce(F.sum(inverse), F.lit(0.0)) / n).alias("rr_mean_groups"),
        F.coalesce(F.max(inverse), F.lit(0.0)).alias("rr_first"),
    ]
    for k in ks:
        aggregates += [
            (at(k) / n).alias(f"recall_at_{k}"),
            (at(k) == n).cast("double").alias(f"sufficiency_at_{k}"),
            (F.coalesce(F.sum(F.when(F.col("c") <= k, discount(F.col("c")))), F.lit(0.0)) / ideal(n, k)).alias(f"ndcg_at_{k}"),
        ]
    return covered.groupBy("qid", "semantics").agg(*aggregates)


def by_stratum(scores: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Means over questions: stratum `all`, then each known semantics that has questions. Unknown labels count in `all`
    only; without questions `all` has n = 0 and zeros."""
    prepare(scores.sparkSession)
    names = ["rr", "rr_mean_groups", "rr_first", *[f"{m}_at_{k}" for m in ("recall", "sufficiency", "ndcg") for k in ks]]
    out = [F.coalesce(F.avg(c), F.lit(0.0)).alias({"rr": "mrr", "rr_mean_groups": "mrr_mean_groups", "rr_first": "mrr_first"}.get(c, c)) for c in names]
    named = scores.where(F.col("semantics").isin(*STRATA)).groupBy(F.col("semantics").alias("stratum")).agg(F.count("*").alias("n"), *out)
    return scores.agg(F.count("*").alias("n"), *out).withColumn("stratum", F.lit("all")).unionByName(named)


def bootstrap_ci(values: DataFrame, keys: Sequence[str], value: str, order: str, iters: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """keys -> mean, lo, hi: resampled with Python's Mersenne Twister in the order of `order`; the bounds are order
    statistics of the means. Null values are left out. One group holds a run's questions of one stratum."""

    def resample(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mean, lo, hi = bootstrap(rows.dropna(subset=[value]).sort_values(order)[value].tolist(), iters, seed, alpha)
        return pd.DataFrame([[*key, mean, lo, hi]], columns=[*keys, "mean", "lo", "hi"])

    kinds = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    return values.select(*keys, order, value).groupBy(*keys).applyInPandas(resample, f"{kinds}, mean double, lo double, hi double")


def bootstrap(values: Sequence[float], iters: int = 10_000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0
    v = np.array(values, float)
    means = np.sort(np.concatenate([_sums(v[drawn.T]) / n for drawn in _draws(n, iters, seed)]))
    return sum(values) / n, float(means[int(alpha / 2 * iters)]), float(means[min(int((1 - alpha / 2) * iters), iters - 1)])


def _draws(n: int, iters: int, seed: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).randrange(n) gives n times an iteration, as blocks of (iterations, n)."""
    state = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, drawn = np.uint64(32 - n.bit_length()), np.empty(0, np.int64)
    while iters:
        rows = min(iters, max(1, DRAWS_AT_ONCE // n))
        while len(drawn) < rows * n:
            more = source.random_raw(2 * (rows * n - len(drawn)) + 64) >> shift
            drawn = np.concatenate([drawn, more[more < n].astype(np.int64)])
        yield drawn[: rows * n].reshape(rows, n)
        drawn, iters = drawn[rows * n :], iters - rows


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns, compensated as Python's sum() of floats is, so to the same bits."""
    total, lost = x[0] + 0.0, np.zeros(x.shape[1])
    for y in x[1:]:
        t = total + y
        lost += np.where(np.abs(total) >= np.abs(y), (total - t) + y, (y - t) + total)
        total = t
    return np.where(np.isfinite(lost), total + lost, total)


def bootstrap_ci_hashed(values: DataFrame, keys: Sequence[str], value: str, order: str, iters: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Like bootstrap_ci, with draws from MD5 instead of the Mersenne Twister: SQL can repeat them, other numbers of the
    same law.

    Draw j of iteration i takes row md5(seed:i:j) mod n. All groups share the digests; iterations spread over tasks."""
    from pyspark.sql.window import Window

    means = hashed_means(values, keys, value, order, iters, seed)
    sorted_means = means.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_m", "_t")) - 1)
    lo, hi = int(alpha / 2 * iters), min(int((1 - alpha / 2) * iters), iters - 1)
    bounds = sorted_means.groupBy(*keys).agg(F.max(F.when(F.col("_at") == lo, F.col("_m"))).alias("lo"), F.max(F.when(F.col("_at") == hi, F.col("_m"))).alias("hi"))
    return values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean")).join(bounds, list(keys))


def hashed_means(values: DataFrame, keys: Sequence[str], value: str, order: str, iters: int, seed: int) -> DataFrame:
    """keys, _t (iteration), _m: means of bootstrap_ci_hashed, to 12 digits. Each block of iterations meets all groups'
    values; like bootstrap_ci, a task holds a run's questions."""

    def resample(block: pa.Table) -> pa.Table:
        groups = [np.array(v, float) for v in block.column("_v").to_pylist()]
        first = block.column("_first")[0].as_py()
        turns = np.arange(first, min(first + TURNS, iters))
        means = np.empty((len(groups), len(turns)))
        for at, t in enumerate(turns.tolist()):
            head = f"{seed}:{t}:".encode()
            digests = b"".join([md5(head + b"%d" % j, usedforsecurity=False).digest() for j in range(max(map(len, groups)))])
            drawn = np.frombuffer(digests, ">u4")[::4].astype(np.int64)
            for g, v in enumerate(groups):
                means[g, at] = v[drawn[: len(v)] % len(v)].sum() / len(v)
        each = pa.array(np.repeat(np.arange(len(groups)), len(turns)))
        return pa.table({k: block.column(k).take(each) for k in keys} | {"_t": np.tile(turns, len(groups)), "_m": means.ravel()})

    kinds = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    row = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    groups = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(row))["v"].alias("_v"))
    blocks = groups.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(iters - 1), F.lit(TURNS))))
    # A number of parts is given, as few bytes would else make one task.
    dealt = blocks.repartition(min(-(-iters // TURNS), 4 * values.sparkSession.sparkContext.defaultParallelism), "_first")
    return dealt.groupBy("_first").applyInArrow(resample, f"{kinds}, _t long, _m double").withColumn("_m", F.round("_m", 12))


def paired(base: DataFrame, candidate: DataFrame, metrics: dict[str, str] = REPORTED) -> DataFrame:
    """Two score_questions() -> stratum, metric, qid, base_value, candidate_value, delta over questions that both have."""
    long = lambda x, name: x.select("qid", "semantics", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(c).cast("double") for c in metrics.values()]))).alias("metric", name))
    x = long(base, "base_value").join(long(candidate, "candidate_value").drop("semantics"), ["qid", "metric"]).withColumn("delta", F.col("candidate_value") - F.col("base_value"))
    strata = F.when(F.col("semantics").isin(*STRATA), F.array(F.lit("all"), F.col("semantics"))).otherwise(F.array(F.lit("all")))
    return x.select(F.explode(strata).alias("stratum"), "metric", "qid", "base_value", "candidate_value", "delta")


def unmatched(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """qid, side: questions that only one run has."""
    a, b = base.select("qid", F.lit(1).alias("_a")), candidate.select("qid", F.lit(1).alias("_b"))
    return a.join(b, "qid", "full_outer").where("_a is null or _b is null").select("qid", F.when(F.col("_a").isNull(), "candidate").otherwise("baseline").alias("side"))


def compare(base: DataFrame, candidate: DataFrame, iters: int = 10_000, seed: int = 0, hashed: bool = False) -> DataFrame:
    """stratum, metric, n, base_mean, candidate_mean, delta, lo, hi, flag (`*` if the interval excludes 0)."""
    x = paired(base, candidate)
    means = x.groupBy("stratum", "metric").agg(F.count("*").alias("n"), F.avg("base_value").alias("base_mean"), F.avg("candidate_value").alias("candidate_mean"))
    ci = (bootstrap_ci_hashed if hashed else bootstrap_ci)(x, ["stratum", "metric"], "delta", "qid", iters, seed).withColumnRenamed("mean", "delta")
    flag = F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), "").when(F.col("delta") > 0, "*").otherwise("* (regression)")
    return means.join(ci, ["stratum", "metric"]).withColumn("flag", flag)


def verdict(comparison: DataFrame) -> DataFrame:
    """One row: delta, lo, regressed (strata whose primary metric's interval lies below 0), fires, outcome (FIRES,
    STAYS, or UNUSABLE if the runs have no question in common) and code (0, 1 and 2 of these)."""
    x = comparison.where(F.col("metric") == PRIMARY)
    pooled = F.col("stratum") == "all"
    y = x.agg(F.max(F.when(pooled, F.col("delta"))).alias("delta"), F.max(F.when(pooled, F.col("lo"))).alias("lo"), F.array_sort(F.collect_set(F.when(~pooled & (F.col("hi") < 0), F.col("stratum")))).alias("regressed"))
    y = y.withColumn("fires", F.coalesce((F.col("delta") > 0) & (F.col("lo") > 0) & (F.size("regressed") == 0), F.lit(False)))
    y = y.withColumn("outcome", F.when(F.col("delta").isNull(), UNUSABLE).when(F.col("fires"), FIRES).otherwise(STAYS))
    return y.withColumn("code", F.when(F.col("outcome") == FIRES, 0).when(F.col("outcome") == STAYS, 1).otherwise(2))


def comparable(base_meta: dict, candidate_meta: dict) -> bool:
    """Runs are only compared if they were scored on the same version of the question set."""
    return base_meta.get("golden_set_version") == candidate_meta.get("golden_set_version")


def decide(base: DataFrame, candidate: DataFrame, base_meta: dict, candidate_meta: dict, iters: int = 10_000, seed: int = 0, hashed: bool = False) -> DataFrame:
    """verdict() of two runs; UNUSABLE if they aren't comparable."""
    usable = comparable(base_meta, candidate_meta)
    return verdict(compare(base if usable else base.limit(0), candidate, iters, seed, hashed))


def movement(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: questions whose rr went up, down or stayed, misses rescued and finds lost."""
    x = base.select("qid", F.col("rr").alias("b")).join(candidate.select("qid", F.col("rr").alias("c")), "qid").withColumn("d", F.col("c") - F.col("b"))
    return x.agg(F.count_if(F.col("d") > EPS).alias("up"), F.count_if(F.col("d") < -EPS).alias("down"), F.count_if(F.abs("d") <= EPS).alias("unchanged"), F.count_if((F.col("b") == 0) & (F.col("c") > 0)).alias("rescued"), F.count_if((F.col("b") > 0) & (F.col("c") == 0)).alias("lost"))


def lost_questions(base: DataFrame, candidate: DataFrame, limit: int = 10) -> DataFrame:
    x = base.select("qid", F.col("rr").alias("b")).join(candidate.select("qid", F.col("rr").alias("c")), "qid")
    return x.where((F.col("b") > 0) & (F.col("c") == 0)).select("qid").orderBy("qid").limit(limit)


def misses(scores: DataFrame, limit: int = 15) -> DataFrame:
    return scores.where(F.col("rr") == 0).orderBy("qid").limit(limit)


def gold_hits(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (qid, rank, chunk_id, found_by, dense_rank, sparse_rank) that are gold."""
    return hits.join(gold.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"]).select("qid", "chunk_id", "rank", "found_by", "dense_rank", "sparse_rank")


def attribution(hits: DataFrame) -> DataFrame:
    """gold_hits() -> found_by, n, share of attributed ones; and how many questions have gold that only BM25 reached."""
    known = F.col("found_by").isin("both", "dense", "bm25")
    rescued = hits.groupBy("qid").agg(F.bool_or(F.col("found_by") == "bm25").alias("r")).agg(F.count_if("r").alias("questions_rescued"))
    x = hits.groupBy(F.when(known, F.col("found_by")).otherwise("none").alias("found_by")).agg(F.count("*").alias("n"))
    total = hits.agg(F.count_if(known).alias("_t"))
    return x.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(rescued)).select("found_by", "n", F.when(F.col("found_by") != "none", F.try_divide(F.col("n"), F.col("_t"))).alias("share"), "questions_rescued")


def spread(per_config: DataFrame, metric: str = PRIMARY) -> DataFrame:
    """Largest less smallest mean of a metric over configurations."""
    return per_config.agg((F.max(metric) - F.min(metric)).alias("spread"))
