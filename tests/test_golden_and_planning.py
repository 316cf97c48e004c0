import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import golden, judging, planning

A, B, C = "2004.04906::p2::c0", "2004.04906::p2::c1", "2404.16130::p5::c0"


def question(qid="q1", groups=((A,),), semantics="any_of", sha=None):
    return {"qid": qid, "question": "what", "semantics": semantics, "gold_groups": [{"chunk_ids": list(g), "note": None} for g in groups], "expected_answer": None, "source_papers": [], "provenance": "", "tags": [], "chunk_text_sha8": sha or {}}


def codes(spark, *qs, **options):
    df = spark.createDataFrame([{"pos": i} | q for i, q in enumerate(qs)], f"pos int, {golden.QUESTIONS}")
    return sorted((r.code, r.severity) for r in golden.validate(df, **options).collect())


def test_every_code(spark):
    known = spark.createDataFrame([(A, "aaaaaaaa"), (B, "b"), (C, "c")], "chunk_id string, text_sha8 string")
    assert codes(spark, question(), known=known) == []
    assert codes(spark, question(), question()) == [("DUP_QID", "error")]
    assert codes(spark, question(qid="")) == [("DUP_QID", "error")]
    assert codes(spark, question(groups=())) == [("EMPTY_GROUPS", "error")]
    assert codes(spark, question(groups=((),))) == [("EMPTY_GROUP", "error")]
    assert codes(spark, question(groups=(("bad",),))) == [("BAD_ID_FORMAT", "error")]
    assert codes(spark, question(groups=((A, C), (C,)), semantics="all_required")) == [("GROUPS_OVERLAP", "error")]
    assert codes(spark, question(groups=((A, A),))) == [("DUP_ID_IN_GROUP", "warn")]
    for q in (question(groups=((A,), (C,))), question(semantics="all_required"), question(semantics="some")):
        assert codes(spark, q) == [("SEMANTICS_MISMATCH", "error")]
    assert codes(spark, question(groups=((A,), (B,)), semantics="all_required")) == [("SUSPICIOUS_MULTIHOP", "warn")]
    assert codes(spark, question(groups=((A,), (C,)), semantics="all_required")) == []
    many = question(groups=tuple((f"p{i}::p0::c0",) for i in range(6)), semantics="all_required")
    assert codes(spark, many) == [("N_GROUPS_EXCEEDS_K", "warn")]
    assert codes(spark, question(groups=(("x::p0::c0",),)), known=known) == [("UNKNOWN_CHUNK_ID", "error")]
    assert codes(spark, question(sha={A: "zzz", "gone::p0::c0": "y"}), known=known) == [("TEXT_DRIFT", "error")]
    assert codes(spark, question(), set_fingerprint="a", collection_fingerprint="b") == [("FINGERPRINT_MISMATCH", "error")]
    assert codes(spark, question(), set_fingerprint="a", collection_fingerprint="a") == []


def test_gate(spark):
    qs = spark.createDataFrame([{"pos": i} | q for i, q in enumerate([question("a"), question("b", ((C,),))])], f"pos int, {golden.QUESTIONS}")
    issues = golden.validate(qs, known=spark.createDataFrame([(A, "x")], "chunk_id string, text_sha8 string"))
    with pytest.raises(ValueError, match="UNKNOWN_CHUNK_ID"):
        golden.usable(qs, issues)
    assert [r.qid for r in golden.usable(qs, issues, allow_unknown=True).collect()] == ["a"]


def test_files(spark, tmp_path):
    whole = {"version": "v1", "corpus_fingerprint": "f", "chunking": {"size": 500}, "questions": [question("a", ((A, B), (C,)), "all_required")]}
    (tmp_path / "g.json").write_text(json.dumps(whole, indent=1))
    g = golden.read(spark, str(tmp_path / "g.json"))
    assert [(r.group_idx, r.chunk_id) for r in golden.gold(golden.questions(g)).collect()] == [(0, A), (0, B), (1, C)]
    golden.write(g, str(tmp_path / "out"))
    assert golden.read(spark, str(tmp_path / "out")).first().asDict(True) == g.first().asDict(True)


def test_leakage(spark):
    q = spark.createDataFrame([("q1", "rag model speed", "c1"), ("q2", "other words entirely", "c1"), ("q3", "the of", "c1")], "qid string, question string, chunk_id string")
    c = spark.createDataFrame([("c1", "the rag model")], "chunk_id string, text string")
    rows = {r.qid: (r.jaccard, r.flagged) for r in golden.leakage(q, c).collect()}
    assert rows == {"q1": (0.6667, True), "q2": (0.0, False), "q3": (0.0, False)}
    s = golden.leakage_summary(golden.leakage(q, c)).first()
    assert (s["median"], s["min"], s["max"], s["n_flagged"]) == (0.0, 0.0, 0.6667, 1)


def test_quotas(spark):
    counts = lambda **k: spark.createDataFrame(list(k.items()), "paper string, n long")
    got = lambda total, **k: {r.paper: r.quota for r in planning.allocate(counts(**k), total).collect()}
    assert got(3, a=5, b=5, c=5) == {"a": 1, "b": 1, "c": 1}
    assert got(10, a=10, b=30) == {"a": 3, "b": 7}
    assert got(5, a=1, b=1) == {"a": 3, "b": 2}  # equal remainders go by paper
    assert sum(got(17, a=3, b=7, c=11).values()) == 17
    with pytest.raises(Exception, match="fewer than papers"):
        got(1, a=1, b=1)


def test_pools_and_draws(spark):
    rows = [("p", f"p{i}", i % 2 == 0) for i in range(6)] + [("z", f"z{i}", False) for i in range(3)]
    screened = spark.createDataFrame(rows, "paper string, chunk_id string, usable boolean")
    pool = planning.pools(screened)
    by = lambda p: [r.chunk_id for r in pool.where(F.col("paper") == p).orderBy("place").collect()]
    assert sorted(by("p")) == ["p0", "p2", "p4"] and sorted(by("z")) == ["z0", "z1", "z2"]
    quotas = spark.createDataFrame([("p", 2), ("z", 1)], "paper string, quota long")
    used = spark.createDataFrame([(by("p")[0],)], "chunk_id string")
    turns = [(r.paper, r.chunk_id) for r in planning.draw(pool, quotas, used).orderBy("turn").collect()]
    assert turns == [("p", by("p")[1]), ("z", by("z")[0]), ("p", by("p")[2])]


def test_near_questions(spark):
    texts = ["rag model speed test", "rag model speed", "other thing here", "rag model", "speed test", "the of", "other thing here"]
    q = spark.createDataFrame(list(enumerate(texts)), "idx int, question string")
    words = [{w for w in t.split() if len(w) > 2 and w not in ("the", "other")} | ({"other"} if "other" in t and "other" not in planning.T.STOPWORDS else set()) for t in texts]
    j = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {(b, a) for b in range(len(texts)) for a in range(b) if j(words[a], words[b]) >= 0.35}
    assert {(r.idx, r.earlier_idx) for r in planning.near_questions(q).collect()} == want
    blocked, taken = {}, []
    for b in range(len(texts)):
        hit = next((a for a in taken if (b, a) in want), None)
        if hit is None:
            taken.append(b)
        else:
            blocked[b] = hit
    assert {r.idx: r.blocked_by for r in planning.accept(q).collect() if not r.accepted} == blocked


def test_rejections(spark):
    s = spark.createDataFrame([("a", False, "too short (3 chars)"), ("b", False, "too short (9 chars)"), ("c", True, "ok")], "chunk_id string, usable boolean, reason string")
    assert [tuple(r) for r in planning.rejections(s).collect()] == [("too short", 2)]


def test_kappa(spark):
    k = lambda *p: judging.kappa(spark.createDataFrame(list(p), "human int, machine int")).first().kappa
    assert k((1, 1), (1, 1)) == 1.0
    assert abs(k((1, 1), (2, 2), (1, 2), (2, 1)) - 0.0) < 1e-12
    assert k((1, 1), (2, 2)) == 1.0
    with pytest.raises(Exception, match="no shared labels"):
        k_empty = judging.kappa(spark.createDataFrame([], "human int, machine int"))
        k_empty.collect()
    pairs = spark.createDataFrame([(1, 2), (5, 5), (2, 4), (4, 4)], "human int, machine int")
    a = judging.agreement(pairs).first()
    assert (a.exact_agreement, a.within_agreement, a.mean_absolute_error, a.rejection_recall) == (0.5, 0.75, 0.75, 0.5)
    assert judging.disagreements(pairs).count() == 1
    assert judging.agreement(spark.createDataFrame([(5, 5)], "human int, machine int")).first().rejection_recall is None


def test_judge(spark):
    asked = []

    def model(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: '[{"text": "Verdict: {\\"groundedness\\": 5, "}, "\\"answer_correctness\\": 2, \\"unsupported_claims\\": [\\"x\\"]}"]' if "good" in p else "no idea")

    answers = spark.createDataFrame([("a", "good", "yes", ["c1", "c2"], "e"), ("b", "bad", "no", ["c"], None)], "qid string, question string, answer string, contexts array<string>, expected_answer string")
    first = judging.judge(answers, model, "m/1")
    rows = {r.qid: r for r in first.collect()}
    assert (rows["a"].groundedness, rows["a"].answer_correctness, rows["a"].unsupported_claims) == (5, 2, ["x"])
    assert rows["b"].groundedness is None and not rows["a"].cached and len(rows["a"].key) == 64
    again = {r.qid: r.cached for r in judging.judge(answers, model, "m/2", first.where("qid = 'a'")).collect()}
    assert again == {"a": True, "b": False}
    v = judging.aggregate(first.where("groundedness is not null")).first()
    assert (v.n, v.pct_fully_grounded, v.judge_pool_blended) == (1, 1.0, False)
    assert judging.aggregate(first.limit(0)).isEmpty()
    assert judging.discriminates(lambda p: pd.Series(['{"groundedness": 1}']))[0]
    assert not judging.discriminates(lambda p: pd.Series(['{"groundedness": 4}']))[0]
    assert not judging.discriminates(lambda p: pd.Series(["?"]))[0]
    del asked
