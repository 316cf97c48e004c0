"""Queries of scoring, comparing, validating and judging, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import dense, fusion, golden, judging, metrics
from plumbline.plans import data, retrieval
from plumbline.sources import saved

#: As many as the operator takes by itself.
ITERS = 10_000
KS = metrics.KS


def hits(spark, sf_dir, arm="hybrid"):
    q = data.asked(spark, sf_dir)
    if arm == "dense":
        return dense.search(data.vectors(spark, sf_dir), q, fusion.POOL)
    return fusion.hybrid(data.index(spark, sf_dir), data.vectors(spark, sf_dir), q, fusion.POOL)


def _scores(spark, sf_dir, arm="hybrid"):
    return metrics.score_questions(metrics.coverage(data.gold(spark, sf_dir), hits(spark, sf_dir, arm).select("qid", F.col("rank").alias("pos"), "chunk_id")))


def run(spark, sf_dir, arm):
    """An arm's run: its questions' scores, kept for each version of the tables, as comparisons read finished runs."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")]
    return saved.table(spark, f"run-{arm}", tables, lambda: _scores(spark, sf_dir, arm))


def question_scores(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select("qid", "semantics", "n_groups", F.array_join(F.transform("coverage_ranks", lambda c: F.coalesce(c.cast("int").cast("string"), F.lit("-"))), ",").alias("coverage"), *[F.round(c, 9).alias(c) for c in s.columns if c not in ("qid", "semantics", "n_groups", "coverage_ranks")])


def scores_sql(fused: str, name: str) -> str:
    """CTE `name` of scored questions over gold and a ranking CTE `fused`."""
    at = "".join(
        f", count(*) FILTER (WHERE c <= {k}) / count(*) AS recall_at_{k}, CAST(count(*) FILTER (WHERE c <= {k}) = count(*) AS DOUBLE) AS sufficiency_at_{k}, "
        f"coalesce(sum(CASE WHEN c <= {k} THEN 1 / log2(c + 1) END), 0) / list_sum(list_transform(generate_series(1, least(count(*), {k})), lambda r: 1 / log2(r + 1))) AS ndcg_at_{k}"
        for k in KS
    )
    return f"""
cov_{name} AS (SELECT g.qid, g.semantics, g.group_idx, CAST(min(f.rank) AS DOUBLE) AS c FROM gold g LEFT JOIN {fused} f ON f.qid = g.qid AND f.chunk_id = g.chunk_id AND f.rank <= 50 GROUP BY ALL),
{name} AS (SELECT qid, semantics, count(*) AS n_groups, string_agg(coalesce(CAST(CAST(c AS INT) AS VARCHAR), '-'), ',' ORDER BY group_idx) AS coverage,
  CASE WHEN count(c) FILTER (WHERE c <= 50) = count(*) THEN 1 / max(c) ELSE 0 END AS rr,
  coalesce(sum(CASE WHEN c <= 50 THEN 1 / c END), 0) / count(*) AS rr_mean_groups, coalesce(1 / min(CASE WHEN c <= 50 THEN c END), 0) AS rr_first{at}
  FROM cov_{name} GROUP BY qid, semantics)"""


METRICS = ["rr", "rr_mean_groups", "rr_first", *[f"{m}_at_{k}" for k in KS for m in ("recall", "sufficiency", "ndcg")]]
BASE = f"WITH {retrieval.fused_sql()}, {data.GOLD}, {scores_sql('fused', 'hybrid')}, {scores_sql('near', 'base')}"
QUESTION_SCORES = f"{BASE} SELECT qid, semantics, n_groups, coverage, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)} FROM hybrid"


def stratum_scores(spark, sf_dir):
    x = metrics.by_stratum(run(spark, sf_dir, "hybrid"))
    return x.select("stratum", "n", *[F.round(c, 9).alias(c) for c in x.columns if c not in ("stratum", "n")])


_mean = {"rr": "mrr", "rr_mean_groups": "mrr_mean_groups", "rr_first": "mrr_first"}
_means = ", ".join(f"round(coalesce(avg({m}), 0), 9) AS {_mean.get(m, m)}" for m in METRICS)
STRATUM_SCORES = f"""{BASE} SELECT 'all' AS stratum, count(*) AS n, {_means} FROM hybrid
UNION ALL SELECT semantics, count(*), {_means} FROM hybrid WHERE semantics IN ('any_of', 'all_required') GROUP BY semantics"""


def compare_hashed(spark, sf_dir):
    x = metrics.compare(run(spark, sf_dir, "dense"), run(spark, sf_dir, "hybrid"), ITERS, 0, hashed=True)
    return x.select("stratum", "metric", "n", *[F.round(c, 7).alias(c) for c in ("base_mean", "candidate_mean", "delta", "lo", "hi")], "flag")


PAIRED = f"""{BASE}, long AS (
  SELECT h.qid, h.semantics, unnest(['mrr', 'recall_at_5', 'sufficiency_at_5', 'ndcg_at_10']) AS metric,
         unnest([b.rr, b.recall_at_5, b.sufficiency_at_5, b.ndcg_at_10]) AS b, unnest([h.rr, h.recall_at_5, h.sufficiency_at_5, h.ndcg_at_10]) AS c
  FROM hybrid h JOIN base b USING (qid)),
pairs AS (SELECT 'all' AS stratum, metric, qid, b, c, c - b AS d FROM long UNION ALL SELECT semantics, metric, qid, b, c, c - b FROM long WHERE semantics IN ('any_of', 'all_required'))"""
COMPARE = f"""{PAIRED},
rows AS (SELECT *, row_number() OVER (PARTITION BY stratum, metric ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY stratum, metric) AS n FROM pairs),
draws AS (
  SELECT s.n, t.t, CAST(('0x' || substr(md5('0:' || t.t || ':' || j.j), 1, 8)) AS BIGINT) % s.n AS i, count(*) AS times
  FROM (SELECT DISTINCT n FROM rows) s, (SELECT unnest(generate_series(0, {ITERS - 1})) AS t) t, (SELECT unnest(generate_series(0, (SELECT max(n) - 1 FROM rows))) AS j) j
  WHERE j.j < s.n GROUP BY ALL),
means AS (SELECT stratum, metric, t, round(sum(times * d) / any_value(n), 12) AS m FROM draws JOIN rows USING (n, i) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum, metric ORDER BY m, t) - 1 AS place FROM means),
ci AS (SELECT stratum, metric, max(CASE WHEN place = {int(0.025 * ITERS)} THEN m END) AS lo, max(CASE WHEN place = {min(int(0.975 * ITERS), ITERS - 1)} THEN m END) AS hi FROM ranked GROUP BY ALL)
SELECT stratum, metric, count(*) AS n, round(avg(b), 7) AS base_mean, round(avg(c), 7) AS candidate_mean, round(avg(d), 7) AS delta, round(any_value(lo), 7) AS lo, round(any_value(hi), 7) AS hi,
       CASE WHEN any_value(lo) <= 0 AND any_value(hi) >= 0 THEN '' WHEN avg(d) > 0 THEN '*' ELSE '* (regression)' END AS flag
FROM pairs JOIN ci USING (stratum, metric) GROUP BY stratum, metric"""


def compare_exact(spark, sf_dir):
    return metrics.compare(run(spark, sf_dir, "dense"), run(spark, sf_dir, "hybrid"), ITERS)


def decision(spark, sf_dir):
    x = metrics.verdict(metrics.compare(run(spark, sf_dir, "dense"), run(spark, sf_dir, "hybrid"), ITERS, 0, hashed=True))
    return x.select(F.round("delta", 7).alias("delta"), F.round("lo", 7).alias("lo"), F.array_join("regressed", ",").alias("regressed"), "fires", "outcome", F.col("code").cast("int").alias("code"))


DECISION = f"""SELECT *, CASE WHEN fires THEN 'fires' WHEN delta IS NULL THEN 'unusable' ELSE 'stays' END AS outcome, CASE WHEN fires THEN 0 WHEN delta IS NULL THEN 2 ELSE 1 END AS code FROM (WITH x AS (SELECT * FROM ({COMPARE}) WHERE metric = 'ndcg_at_10')
SELECT max(CASE WHEN stratum = 'all' THEN delta END) AS delta, max(CASE WHEN stratum = 'all' THEN lo END) AS lo,
       coalesce(string_agg(CASE WHEN stratum <> 'all' AND hi < 0 THEN stratum END, ',' ORDER BY stratum), '') AS regressed,
       coalesce(max(CASE WHEN stratum = 'all' THEN delta END) > 0 AND max(CASE WHEN stratum = 'all' THEN lo END) > 0 AND count(*) FILTER (WHERE stratum <> 'all' AND hi < 0) = 0, false) AS fires
FROM x)"""


def run_movement(spark, sf_dir):
    return metrics.movement(run(spark, sf_dir, "dense"), run(spark, sf_dir, "hybrid"))


MOVEMENT = f"""{BASE}, m AS (SELECT b.rr AS b, h.rr AS c, h.rr - b.rr AS d FROM hybrid h JOIN base b USING (qid))
SELECT count(*) FILTER (WHERE d > 1e-9) AS up, count(*) FILTER (WHERE d < -1e-9) AS down, count(*) FILTER (WHERE abs(d) <= 1e-9) AS unchanged,
       count(*) FILTER (WHERE b = 0 AND c > 0) AS rescued, count(*) FILTER (WHERE b > 0 AND c = 0) AS lost FROM m"""


def first_misses(spark, sf_dir):
    return metrics.misses(run(spark, sf_dir, "dense")).select("qid", "semantics", "n_groups")


MISSES = f"{BASE} SELECT qid, semantics, n_groups FROM base WHERE rr = 0 ORDER BY qid LIMIT 15"


def arm_attribution(spark, sf_dir):
    hits = fusion.hybrid(data.index(spark, sf_dir), data.vectors(spark, sf_dir), data.asked(spark, sf_dir), fusion.POOL)
    x = metrics.attribution(saved.kept(metrics.gold_hits(data.gold(spark, sf_dir), hits), "gold-hits"))
    return x.withColumn("share", F.round("share", 9))


ATTRIBUTION = f"""{BASE}, hits AS (SELECT f.qid, f.chunk_id, {retrieval.FOUND_BY} AS found_by FROM fused f JOIN (SELECT DISTINCT qid, chunk_id FROM gold) g USING (qid, chunk_id) WHERE f.rank <= 50)
SELECT found_by, count(*) AS n, round(count(*) / (SELECT count(*) FROM hits), 9) AS share, (SELECT count(DISTINCT qid) FROM hits WHERE found_by = 'bm25') AS questions_rescued FROM hits GROUP BY found_by"""


def _configs(spark):
    rows = [("k10", 10.0, 1.0, 1.0), ("k30", 30.0, 1.0, 1.0), ("k60", 60.0, 1.0, 1.0), ("k100", 100.0, 1.0, 1.0), ("k60_dense2", 60.0, 2.0, 1.0), ("k60_bm25x2", 60.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "config string, k double, dense_weight double, bm25_weight double")


def rrf_sweep(spark, sf_dir):
    ranked = fusion.sweep(retrieval.ranked_arms(spark, sf_dir), _configs(spark), fusion.POOL)
    g = data.gold(spark, sf_dir).crossJoin(F.broadcast(_configs(spark).select("config")))
    key = lambda df: df.withColumn("qid", F.concat_ws("|", "config", "qid"))
    scored = metrics.score_questions(metrics.coverage(key(g), key(ranked).select("qid", F.col("rank").alias("pos"), "chunk_id")))
    x = saved.kept(scored.groupBy(F.substring_index("qid", "|", 1).alias("config")).agg(F.avg("rr").alias("mrr"), F.avg("ndcg_at_10").alias("ndcg_at_10")), "sweep")
    spread = metrics.spread(x.where(~F.col("config").contains("_")))
    return x.crossJoin(F.broadcast(spread)).select("config", *[F.round(c, 9).alias(c) for c in ("mrr", "ndcg_at_10", "spread")])


RRF_SWEEP = f"""WITH {retrieval.fused_sql()}, {data.GOLD},
configs(config, k, wd, wb) AS (VALUES ('k10', 10.0, 1.0, 1.0), ('k30', 30.0, 1.0, 1.0), ('k60', 60.0, 1.0, 1.0), ('k100', 100.0, 1.0, 1.0), ('k60_dense2', 60.0, 2.0, 1.0), ('k60_bm25x2', 60.0, 1.0, 2.0)),
all_fused AS (SELECT config, qid, chunk_id, row_number() OVER (PARTITION BY config, qid ORDER BY s DESC, chunk_id) AS rank FROM (
  SELECT config, qid, chunk_id, round(coalesce(CAST(wd AS DOUBLE) / (k + dense_rank), 0) + coalesce(CAST(wb AS DOUBLE) / (k + sparse_rank), 0), 12) AS s FROM joined, configs)),
cov AS (SELECT c.config, g.qid, g.group_idx, CAST(min(f.rank) AS DOUBLE) AS c FROM gold g CROSS JOIN configs c LEFT JOIN all_fused f ON f.config = c.config AND f.qid = g.qid AND f.chunk_id = g.chunk_id AND f.rank <= 50 GROUP BY ALL),
per AS (SELECT config, qid, CASE WHEN count(c) = count(*) THEN 1 / max(c) ELSE 0 END AS rr,
  coalesce(sum(CASE WHEN c <= 10 THEN 1 / log2(c + 1) END), 0) / list_sum(list_transform(generate_series(1, least(count(*), 10)), lambda r: 1 / log2(r + 1))) AS ndcg FROM cov GROUP BY ALL),
m AS (SELECT config, avg(rr) AS mrr, avg(ndcg) AS ndcg FROM per GROUP BY config)
SELECT config, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg_at_10, round((SELECT max(ndcg) - min(ndcg) FROM m WHERE config NOT LIKE '%\\_%' ESCAPE '\\'), 9) AS spread FROM m"""


def _broken(spark, sf_dir):
    """Questions whose defects follow their number: a set with every fault in it."""
    b = data.table(spark, sf_dir, "benchmark").select("item_id", "text")
    i = F.col("item_id")
    cid = lambda n: F.concat(i.cast("string"), F.lit(f"::p0::c{n}"))
    group = lambda *ids: F.struct(F.array(*ids).cast("array<string>").alias("chunk_ids"), F.lit(None).cast("string").alias("note"))
    kinds = [
        F.array(group(cid(0))), F.array(group(cid(0)), group(cid(1))), F.array().cast("array<struct<chunk_ids:array<string>,note:string>>"), F.array(group(cid(0), cid(0))),
        F.array(group(F.lit("not-an-id"))), F.array(group(cid(0)), group(cid(0))), F.array(group()), F.array(*[group(cid(n)) for n in range(6)]),
    ]
    groups = kinds[0]
    for n, kind in enumerate(kinds[1:], 1):
        groups = F.when(i % 8 == n, kind).otherwise(groups)
    qid = F.when(i % 16 == 15, F.lit("")).when(i % 16 == 9, F.concat(F.lit("g"), (i - 1).cast("string"))).otherwise(F.concat(F.lit("g"), i.cast("string")))
    semantics = F.when((i % 8).isin(1, 5), "all_required").when(i % 24 == 3, "other").otherwise("any_of")
    drift = F.create_map(cid(0), F.lit("00000000"))
    return b.select(i.alias("pos"), qid.alias("qid"), F.col("text").alias("question"), semantics.alias("semantics"), groups.alias("gold_groups"), drift.alias("chunk_text_sha8"))


def golden_issues(spark, sf_dir):
    known = data.chunks(spark, sf_dir).select("chunk_id", "text_sha8")
    x = golden.validate(_broken(spark, sf_dir), known=known, set_fingerprint="sha256:a", collection_fingerprint="sha256:b")
    return x.select("severity", "code", "qid", "detail")


GOLDEN = f"""WITH {data.CHUNKS},
q AS (
  SELECT item_id AS pos, CASE WHEN item_id % 16 = 15 THEN '' WHEN item_id % 16 = 9 THEN 'g' || (item_id - 1) ELSE 'g' || item_id END AS qid,
    CASE WHEN item_id % 8 IN (1, 5) THEN 'all_required' WHEN item_id % 24 = 3 THEN 'other' ELSE 'any_of' END AS semantics, item_id % 8 AS kind, CAST(item_id AS VARCHAR) AS i,
    CASE item_id % 8 WHEN 0 THEN [[0]] WHEN 1 THEN [[0], [1]] WHEN 2 THEN [] WHEN 3 THEN [[0, 0]] WHEN 4 THEN [[-1]] WHEN 5 THEN [[0], [0]] WHEN 6 THEN [[]] ELSE [[0], [1], [2], [3], [4], [5]] END AS gs
  FROM benchmark),
named AS (SELECT * FROM q WHERE qid <> ''),
g AS (SELECT pos, qid, semantics, i, gi - 1 AS group_idx, gs[gi] AS ids FROM (SELECT *, unnest(generate_series(1, len(gs))) AS gi FROM named)),
m AS (SELECT pos, qid, semantics, group_idx, spot, CASE WHEN ids[spot] < 0 THEN 'not-an-id' ELSE i || '::p0::c' || ids[spot] END AS chunk_id, ids[spot] AS ordinal FROM (SELECT *, unnest(generate_series(1, len(ids))) AS spot FROM g))
SELECT 'error' AS severity, 'FINGERPRINT_MISMATCH' AS code, NULL AS qid, '' AS detail
UNION ALL SELECT 'error', 'DUP_QID', NULL, 'empty qid' FROM q WHERE qid = ''
UNION ALL SELECT 'error', 'DUP_QID', qid, '' FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM named) WHERE n > 1
UNION ALL SELECT 'error', 'EMPTY_GROUPS', qid, '' FROM named WHERE len(gs) = 0
UNION ALL SELECT 'error', 'EMPTY_GROUP', qid, CAST(group_idx AS VARCHAR) FROM g WHERE len(ids) = 0
UNION ALL SELECT 'warn', 'DUP_ID_IN_GROUP', qid, CAST(group_idx AS VARCHAR) FROM g WHERE len(list_distinct(ids)) < len(ids)
UNION ALL SELECT 'error', 'BAD_ID_FORMAT', qid, chunk_id FROM m WHERE NOT regexp_full_match(chunk_id, '[^:]+::p\\d+::c\\d+')
UNION ALL SELECT 'error', 'GROUPS_OVERLAP', qid, chunk_id FROM (SELECT *, lag(group_idx) OVER (PARTITION BY pos, chunk_id ORDER BY group_idx, spot) AS l FROM m) WHERE l <> group_idx
UNION ALL SELECT 'error', 'SEMANTICS_MISMATCH', qid, semantics FROM named WHERE len(gs) > 0 AND (semantics = 'other' OR (semantics = 'any_of' AND len(gs) <> 1) OR (semantics = 'all_required' AND len(gs) < 2))
UNION ALL SELECT 'warn', 'SUSPICIOUS_MULTIHOP', a.qid, a.group_idx || '/' || b.group_idx FROM m a JOIN m b ON a.pos = b.pos AND a.group_idx < b.group_idx AND abs(a.ordinal - b.ordinal) <= 1 WHERE a.semantics = 'all_required' AND a.spot = 1 AND b.spot = 1
UNION ALL SELECT 'warn', 'N_GROUPS_EXCEEDS_K', qid, CAST(len(gs) AS VARCHAR) FROM named WHERE len(gs) > 5
UNION ALL SELECT 'error', 'UNKNOWN_CHUNK_ID', qid, chunk_id FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT 'error', 'TEXT_DRIFT', n.qid, c.chunk_id FROM named n JOIN chunks c ON c.chunk_id = n.i || '::p0::c0' WHERE len(n.gs) > 0 AND substr(sha256(c.text), 1, 8) <> '00000000'"""


def _leaks(spark, sf_dir):
    q = data.questions(spark, sf_dir).select("qid", F.col("text").alias("question"))
    return golden.leakage(q.join(data.gold(spark, sf_dir).select("qid", "chunk_id"), "qid"), data.chunks(spark, sf_dir))


def question_leakage(spark, sf_dir):
    return _leaks(spark, sf_dir)


def question_leakage_summary(spark, sf_dir):
    return golden.leakage_summary(_leaks(spark, sf_dir))


_stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"
_content = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_stop}, w)))"
LEAKAGE = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, {data.GOLD},
w AS (SELECT g.qid, g.chunk_id, {_content.format('q.text')} AS a, {_content.format('c.text')} AS b FROM gold g JOIN questions q USING (qid) JOIN chunks c USING (chunk_id)),
j AS (SELECT qid, chunk_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM w)
SELECT qid, chunk_id, CAST(round(j, 4) AS DOUBLE) AS jaccard, j >= 0.35 AS flagged FROM j"""
LEAKAGE_SUMMARY = f"WITH l AS ({LEAKAGE}), s AS (SELECT list_sort(list(jaccard)) AS v, count(*) FILTER (WHERE flagged) AS n_flagged FROM l) SELECT v[len(v) // 2 + 1] AS median, list_min(v) AS min, list_max(v) AS max, n_flagged FROM s"


def _labels(spark, sf_dir):
    x = data.table(spark, sf_dir, "labels")
    side = lambda c: x.select(F.col("doc_id").alias("id"), (1 + 2 * F.col(c)).alias("label"))
    return judging.shared_labels(side("quality"), side("toxic"))


def label_agreement(spark, sf_dir):
    x = judging.agreement(_labels(spark, sf_dir))
    return x.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


AGREEMENT = """WITH p AS (SELECT 1 + 2 * quality AS h, 1 + 2 * toxic AS m FROM labels),
s AS (SELECT count(*) AS n, avg(CAST(h = m AS INT)) AS po, avg(CAST(abs(h - m) <= 1 AS INT)) AS near, avg(abs(h - m)) AS mae,
  count(*) FILTER (WHERE h <= 2) AS bad, count(*) FILTER (WHERE h <= 2 AND m <= 2) AS caught FROM p),
e AS (SELECT sum(ph * pm) AS pe FROM (SELECT h AS l, count(*) / (SELECT n FROM s) AS ph FROM p GROUP BY h) JOIN (SELECT m AS l, count(*) / (SELECT n FROM s) AS pm FROM p GROUP BY m) USING (l))
SELECT n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 9) AS cohens_kappa, round(po, 9) AS exact_agreement, round(near, 9) AS within_agreement, round(mae, 9) AS mean_absolute_error,
       bad AS n_human_rejected, caught AS n_judge_also_rejected, round(caught / nullif(bad, 0), 9) AS rejection_recall FROM s, e"""


def label_disagreements(spark, sf_dir):
    return judging.disagreements(_labels(spark, sf_dir)).select("id", "human", "machine")


DISAGREEMENTS = "SELECT doc_id AS id, 1 + 2 * quality AS human, 1 + 2 * toxic AS machine FROM labels WHERE abs(2 * quality - 2 * toxic) > 1"


def _verdicts(spark, sf_dir):
    x = data.table(spark, sf_dir, "labels")
    return x.select(F.col("doc_id").cast("string").alias("qid"), (1 + 4 * F.col("quality")).alias("groundedness"), (5 - 4 * F.col("toxic")).alias("answer_correctness"), F.when(F.col("doc_id") % 3 == 0, "a/one").otherwise("b/two").alias("judge_model"))


def verdict_summary(spark, sf_dir):
    x = judging.aggregate(_verdicts(spark, sf_dir))
    return x.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


VERDICTS = """SELECT count(*) AS n, round(avg(1 + 4 * quality), 9) AS mean_groundedness, round(avg(5 - 4 * toxic), 9) AS mean_answer_correctness, round(avg(CAST(quality = 1 AS INT)), 9) AS pct_fully_grounded,
round(avg(CAST(quality = 0 AS INT)), 9) AS pct_ungrounded, count(DISTINCT doc_id % 3 = 0) AS n_models, count(DISTINCT doc_id % 3 = 0) > 1 AS judge_pool_blended FROM labels"""


def verdicts_per_model(spark, sf_dir):
    return judging.per_model(_verdicts(spark, sf_dir))


PER_MODEL = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'a/one' ELSE 'b/two' END AS judge_model, count(*) AS n FROM labels GROUP BY 1"


def judge_with_cache(spark, sf_dir):
    """A stub model judges the questions' answers; half of them are in the cache already."""
    import pandas as pd

    def stub(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: f'Here: {{"groundedness": {1 + len(p) % 5}, "answer_correctness": {1 + len(p) % 3}, "unsupported_claims": [], "rationale": "length"}}')

    q = data.questions(spark, sf_dir)
    answers = q.select("qid", "item_id", F.col("text").alias("question"), F.col("passage").alias("answer"), F.array("passage").alias("contexts"), F.lit("").alias("expected_answer"))
    old = judging.judge(answers.where("item_id % 2 = 0"), stub, "stub/old")
    return judging.judge(answers, stub, "stub/new", old).select("qid", "groundedness", "answer_correctness", "judge_model", "cached")


_rest = len(judging.PROMPT) - len("{question}{contexts}{answer}{expected}") + len("[1] ")
JUDGED = f"""WITH {data.QUESTIONS}, p AS (SELECT DISTINCT qid, item_id, {_rest} + length(text) + 2 * length(passage) AS n FROM questions)
SELECT qid, CAST(1 + n % 5 AS INT) AS groundedness, CAST(1 + n % 3 AS INT) AS answer_correctness, CASE WHEN item_id % 2 = 0 THEN 'stub/old' ELSE 'stub/new' END AS judge_model, item_id % 2 = 0 AS cached FROM p"""


QUERIES = {
    "question_scores": (question_scores, QUESTION_SCORES),
    "stratum_scores": (stratum_scores, STRATUM_SCORES),
    "compare_runs": (compare_hashed, COMPARE),
    "compare_runs_twister": (compare_exact, None),
    "decision_rule": (decision, DECISION),
    "run_movement": (run_movement, MOVEMENT),
    "first_misses": (first_misses, MISSES),
    "arm_attribution": (arm_attribution, ATTRIBUTION),
    "rrf_sweep": (rrf_sweep, RRF_SWEEP),
    "golden_issues": (golden_issues, GOLDEN),
    "question_leakage": (question_leakage, LEAKAGE),
    "question_leakage_summary": (question_leakage_summary, LEAKAGE_SUMMARY),
    "label_agreement": (label_agreement, AGREEMENT),
    "label_disagreements": (label_disagreements, DISAGREEMENTS),
    "verdict_summary": (verdict_summary, VERDICTS),
    "verdicts_per_model": (verdicts_per_model, PER_MODEL),
    "judge_with_cache": (judge_with_cache, JUDGED),
}
