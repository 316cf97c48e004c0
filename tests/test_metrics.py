import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M

D = {r: 1 / math.log2(r + 1) for r in range(1, 200)}


def score(spark, cases, **options):
    """cases: {qid: (ranking, groups)} or with semantics -> {qid: row}"""
    gold = [(q, c[2] if len(c) > 2 else ("any_of" if len(c[1]) == 1 else "all_required"), i, m) for q, c in cases.items() for i, g in enumerate(c[1]) for m in g]
    ranking = [(q, i + 1, x) for q, c in cases.items() for i, x in enumerate(c[0])]
    g = spark.createDataFrame(gold, "qid string, semantics string, group_idx int, chunk_id string")
    r = spark.createDataFrame(ranking, "qid string, pos int, chunk_id string")
    return {x.qid: x for x in M.score_questions(M.coverage(g, r), **options).collect()}


def near(a, b):
    return abs(a - b) < 1e-12


CASES = {
    "t1": ("axy", ["a"]),
    "t2": ("xab", ["ab"]),
    "t3": ("xa", ["ab"]),
    "t4": ("xyz", ["a"]),
    "t5": ("pxyqz", ["p", "q"]),
    "t6": ("pxyz", ["p", "q"]),
    "t7": (["a2", "a1", "x", "b1", "b2"], [["a1", "a2"], ["b1", "b2"]]),
    "t8": ("xba", ["ba"]),
    "t9": ("abc", ["a", "b", "c"]),
    "t12": ("", ["a"]),
    "t13": ("aab", ["b"]),
    "t16": ([f"x{i}" for i in range(59)] + ["a"], ["a"]),
}


def test_hand_computed(spark):
    s = score(spark, CASES, ks=(2, 3, 5, 10))
    assert s["t1"].rr == s["t1"].ndcg_at_10 == s["t1"].recall_at_5 == 1
    assert s["t2"].rr == 0.5 and s["t2"].recall_at_5 == 1 and near(s["t2"].ndcg_at_10, D[2])
    names = [c for c in s["t2"].asDict() if c not in ("qid",)]
    assert all(s["t2"][c] == s["t3"][c] for c in names) and all(s["t2"][c] == s["t8"][c] for c in names)
    assert s["t4"].rr == s["t4"].rr_first == s["t4"].recall_at_10 == s["t4"].ndcg_at_10 == 0
    assert s["t4"].coverage_ranks == [None] and s["t5"].coverage_ranks == [1.0, 4.0]
    for t in ("t5", "t7"):
        assert s[t].rr == 0.25 and s[t].rr_mean_groups == 0.625 and s[t].rr_first == 1
        assert s[t].recall_at_3 == 0.5 and s[t].sufficiency_at_3 == 0 and s[t].sufficiency_at_5 == 1
        assert near(s[t].ndcg_at_10, (D[1] + D[4]) / (D[1] + D[2]))
    assert s["t6"].rr == 0 and s["t6"].rr_mean_groups == 0.5 and s["t6"].rr_first == 1 and s["t6"].recall_at_5 == 0.5
    assert near(s["t6"].ndcg_at_10, D[1] / (D[1] + D[2]))
    assert near(s["t9"].ndcg_at_2, 1) and near(s["t9"].recall_at_2, 2 / 3)
    assert s["t12"].rr == 0 and s["t13"].rr == 0.5
    assert s["t16"].rr == 0 and near(score(spark, {"t16": CASES["t16"]}, cap=None)["t16"].rr, 1 / 60)
    with pytest.raises(ValueError):
        score(spark, {"t1": CASES["t1"]}, ks=(0,))


def test_random_bounds(spark):
    r = random.Random(3)
    cases = {}
    for i in range(150):
        items = [f"i{j}" for j in range(30)]
        r.shuffle(items)
        members = r.sample(items, 10)
        groups = [members[2 * g : 2 * g + 2] for g in range(r.randint(1, 5))]
        ranking = items[: r.randint(0, 30)]
        cases[f"a{i}"] = (ranking, groups)
        if len(ranking) > 1:
            at = r.randrange(1, len(ranking))
            if ranking[at] in members[: 2 * len(groups)]:  # a relevant item moves up
                better = ranking[:]
                better[at - 1], better[at] = better[at], better[at - 1]
                if ranking[at - 1] not in members[: 2 * len(groups)]:
                    cases[f"b{i}"] = (better, groups)
    s = score(spark, cases)
    assert all(0 <= x.ndcg_at_10 <= 1 + 1e-12 for x in s.values())
    for q, x in s.items():
        if q[0] == "b":
            old = s["a" + q[1:]]
            assert x.ndcg_at_10 >= old.ndcg_at_10 - 1e-12 and x.rr >= old.rr - 1e-12


def test_groups_must_be_disjoint(spark):
    schema = "qid string, semantics string, group_idx int, chunk_id string"
    good = spark.createDataFrame([("q", "all_required", 0, "a"), ("q", "all_required", 1, "b"), ("q", "all_required", 1, "b")], schema)
    assert M.check_groups(good).count() == 3
    for bad in ([("q", "all_required", 0, "a"), ("q", "all_required", 1, "a")], [("q", "any_of", 0, None)]):
        with pytest.raises(Exception, match="non-empty and disjoint"):
            M.check_groups(spark.createDataFrame(bad, schema)).collect()


def runs(spark):
    base = {f"q{i}": ("wxyza" if i % 2 else "xya", ["a"]) for i in range(8)} | {"m1": ("pxq", ["p", "q"]), "z": ("x", ["a"], "odd")}
    cand = {f"q{i}": ("xa" if i else "xy", ["a"]) for i in range(8)} | {"m1": ("pq", ["p", "q"]), "z": ("a", ["a"], "odd")}
    frame = lambda c: spark.createDataFrame(list(score(spark, c).values()))
    return frame(base), frame(cand)


def test_strata(spark):
    base, _ = runs(spark)
    rows = {r.stratum: r for r in M.by_stratum(base).collect()}
    assert {k: v.n for k, v in rows.items()} == {"all": 10, "any_of": 8, "all_required": 1}
    assert near(rows["any_of"].mrr, (1 / 5 + 1 / 3) / 2)
    empty = M.by_stratum(base.limit(0)).collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].mrr == 0


def test_compare(spark):
    base, cand = runs(spark)
    exact = {(r.stratum, r.metric): r for r in M.compare(base, cand, 500).collect()}
    hashed = {(r.stratum, r.metric): r for r in M.compare(base, cand, 500, hashed=True).collect()}
    assert exact.keys() == hashed.keys() and len(exact) == 12
    b, c = ({r.qid: r.rr for r in x.collect()} for x in (base, cand))
    deltas = [c[q] - b[q] for q in sorted(b)]
    mean, lo, hi = M.bootstrap(deltas, 500)
    got = exact["all", "mrr"]
    assert near(got.delta, mean) and near(got.lo, lo) and near(got.hi, hi) and got.lo <= got.delta <= got.hi
    assert near(hashed["all", "mrr"].delta, mean) and abs(hashed["all", "mrr"].lo - lo) < 0.15
    m = M.movement(base, cand).first()
    assert (m.up, m.down, m.unchanged, m.rescued, m.lost) == (9, 1, 0, 1, 1)
    assert [r.qid for r in M.lost_questions(base, cand).collect()] == ["q0"]
    assert [r.qid for r in M.misses(base).collect()] == ["z"]
    v = M.verdict(M.compare(base, cand, 300)).first()
    assert v.fires == (v.delta > 0 and v.lo > 0 and not v.regressed)
    assert {(r.qid, r.side) for r in M.unmatched(base.where("qid <> 'q1'"), cand.where("qid <> 'q2'")).collect()} == {("q1", "candidate"), ("q2", "baseline")}


def test_bootstrap():
    assert M.bootstrap([]) == (0.0, 0.0, 0.0)
    mean, lo, hi = M.bootstrap([0.3] * 40, 1000)
    assert near(mean, 0.3) and abs(lo - 0.3) < 1e-12 and abs(hi - 0.3) < 1e-12
    assert M.bootstrap([0, 1, 2, 5], 200) == M.bootstrap([0, 1, 2, 5], 200)


def test_attribution(spark):
    hits = spark.createDataFrame([("q1", "a", "both"), ("q1", "b", "bm25"), ("q2", "c", "dense"), ("q2", "d", None)], "qid string, chunk_id string, found_by string")
    rows = {r.found_by: r for r in M.attribution(hits).collect()}
    assert rows["none"].n == 1 and rows["none"].share is None and near(rows["both"].share, 1 / 3)
    assert all(r.questions_rescued == 1 for r in rows.values())
    assert M.spread(spark.createDataFrame([(0.5,), (0.75,)], "ndcg_at_10 double")).first()[0] == 0.25
    assert M.gold_hits(spark.createDataFrame([("q1", "a")], "qid string, chunk_id string"), hits.withColumn("rank", F.lit(1)).withColumn("dense_rank", F.lit(1)).withColumn("sparse_rank", F.lit(1))).count() == 1


@pytest.mark.parametrize("most", [50, 2_000_000])
def test_draws_are_those_of_the_mersenne_twister(monkeypatch, most):
    monkeypatch.setattr(M, "DRAWS_AT_ONCE", most)
    r = random.Random(3)
    for n in (1, 2, 7, 33, 64):
        values = [r.choice([0.0, 0.1, -0.1, 1 / 3, r.uniform(-1, 1)]) for _ in range(n)]
        rng = random.Random(9)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(120))
        assert M.bootstrap(values, 120, 9) == (sum(values) / n, means[3], means[117])


def test_bootstrap_draws_a_block_at_a_time(monkeypatch):
    def never(*_):
        raise AssertionError("a call for each draw")

    monkeypatch.setattr(random.Random, "randrange", never)
    assert M.bootstrap([0.5, 1.0], 50)[0] == 0.75


def test_hashed_means(spark):
    r = random.Random(4)
    groups = {(k, m): [r.uniform(-1, 1) for _ in range(n)] for k, m, n in (("a", "x", 5), ("a", "y", 5), ("b", "x", 130), (None, "x", 1))}
    rows = [(k, m, f"q{i:03}", v) for (k, m), vs in groups.items() for i, v in enumerate(vs)] + [("a", "x", "q9", None), ("c", "x", "q0", None)]
    r.shuffle(rows)
    got = M.hashed_means(spark.createDataFrame(rows, "k string, m string, qid string, v double"), ["k", "m"], "v", "qid", 250, 7)
    assert got.rdd.getNumPartitions() > 1  # few bytes, but much work
    draw = lambda t, j, n: int(hashlib.md5(f"7:{t}:{j}".encode()).hexdigest()[:8], 16) % n
    means = {(*g, t): sum(vs[draw(t, j, len(vs))] for j in range(len(vs))) / len(vs) for g, vs in groups.items() for t in range(250)}
    found = {(x.k, x.m, x._t): x._m for x in got.collect()}
    assert found.keys() == means.keys() and all(abs(found[x] - means[x]) < 2e-12 for x in means)
