import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bm25, chunking, dense, fusion

CORPUS = [
    ("d1", "granite blocks carried by a tow-boat along canals"),
    ("d2", "granite blocks and slate blocks weighed against standard weights scale"),
    ("d3", "harbourmaster9 keeps tidal ledgers for night arrivals"),
    ("d4", "blocks blocks blocks blocks"),
]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(CORPUS, "chunk_id string, text string"))


def ask(spark, index, *texts, k=10):
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, text string")
    rows = bm25.search(index, q, k).orderBy("qid", "rank").collect()
    return [[(r.chunk_id, r.score) for r in rows if r.qid == f"q{i}"] for i in range(len(texts))]


def plain(corpus, query, k1=1.2, b=0.75, variant="lucene"):
    docs = {i: T.tokenize_python(t) for i, t in corpus}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    if variant == "lucene":
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    else:
        raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = {}
    for i, d in docs.items():
        hit = [t for t in T.tokenize_python(query) if t in d]
        if hit:
            out[i] = sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in hit)
    return sorted(out.items(), key=lambda x: (-round(x[1], 7), x[0]))


def test_scores(spark, index):
    for q, got in zip(qs := ["tidal ledgers", "granite blocks", "blocks", "tow-boat scale", "blocks blocks"], ask(spark, index, *qs), strict=True):
        want = plain(CORPUS, q)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def test_properties(spark, index):
    residual, unknown, one, two = ask(spark, index, "tidal ledgers", "zebra", "granite", "granite granite")
    assert residual[0][0] == "d3" and unknown == []
    assert all(abs(2 * a - b) < 1e-6 for (_, a), (_, b) in zip(one, two, strict=True))
    assert index.terms.where("idf <= 0").isEmpty()
    okapi = bm25.build(spark.createDataFrame(CORPUS, "chunk_id string, text string"), variant="okapi")
    assert okapi.terms.where("term = 'blocks'").first().idf > 0


def test_ties_go_by_id(spark):
    for order in (["b", "a"], ["a", "b"]):
        i = bm25.build(spark.createDataFrame([(c, "same words") for c in order], "chunk_id string, text string"))
        assert [c for c, _ in ask(spark, i, "same")[0]] == ["a", "b"]


def test_explain(spark, index):
    q = spark.createDataFrame([("q0", "granite blocks blocks zebra")], "qid string, text string")
    pairs = spark.createDataFrame([("q0", "d2")], "qid string, chunk_id string")
    rows = bm25.explain(index, q, pairs).collect()
    assert [r.term for r in rows] == ["blocks", "granite"] or [r.term for r in rows] == ["granite", "blocks"]
    score = bm25.search(index, q, 10).where("chunk_id = 'd2'").first().score
    assert abs(sum(r.value for r in rows) - score) < 1e-6
    with pytest.raises(Exception, match="unknown chunk_id"):
        bm25.explain(index, q, spark.createDataFrame([("q0", "zz")], "qid string, chunk_id string")).collect()


def test_bad_input(spark):
    with pytest.raises(ValueError):
        bm25.build(spark.createDataFrame(CORPUS, "chunk_id string, text string"), variant="x")
    twice = bm25.build(spark.createDataFrame([CORPUS[0], CORPUS[0]], "chunk_id string, text string"))
    with pytest.raises(Exception, match="duplicate chunk_id"):
        twice.docs.collect()


def test_empty_corpus_and_texts(spark):
    empty = bm25.build(spark.createDataFrame([], "chunk_id string, text string"))
    assert ask(spark, empty, "x")[0] == []
    assert empty.stats.first().asDict() == {"n_docs": 0, "avgdl": 0.0}
    some = bm25.build(spark.createDataFrame([("a", ""), ("b", "x y")], "chunk_id string, text string"))
    assert some.stats.first().asDict() == {"n_docs": 2, "avgdl": 1.0}


def test_saved(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = bm25.Index.load(spark, str(tmp_path))
    assert not (tmp_path / "tokens").exists()
    one = bm25.search_one(again, spark, "granite blocks", 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in one] == ask(spark, index, "granite blocks", k=2)[0]
    assert ask(spark, again, "granite") == ask(spark, index, "granite")


def ranked(spark, **lists):
    rows = [("q", arm, i + 1, c) for arm, items in lists.items() for i, c in enumerate(items)]
    return spark.createDataFrame(rows, "qid string, arm string, pos int, chunk_id string")


def test_rrf(spark):
    rows = fusion.rrf(ranked(spark, dense=["a", "b", "c"], bm25=["b", "d", "a"])).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "d", "c"]
    want = {"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 61, "c": 1 / 63, "d": 1 / 62}
    assert all(abs(r.rrf_score - want[r.chunk_id]) < 1e-12 for r in rows)
    assert {r.chunk_id: dict(r.ranks) for r in rows}["c"] == {"dense": 3}
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert ids(fusion.rrf(ranked(spark, dense=["x", "y"]))) == ["x", "y"]
    zero = fusion.rrf(ranked(spark, dense=["a"], bm25=["b"]), weights={"bm25": 0.0}).orderBy("rank").collect()
    assert [(r.chunk_id, r.rrf_score) for r in zero][1] == ("b", 0.0)
    assert ids(fusion.rrf(ranked(spark, dense=["a", "a", "b"], bm25=["b"]))) == ["b", "a"]
    assert ids(fusion.rrf(ranked(spark, dense=["b"], bm25=["a"]))) == ["a", "b"]
    assert ids(fusion.rrf(ranked(spark, dense=[], bm25=[]))) == []
    with pytest.raises(ValueError):
        fusion.rrf(ranked(spark, dense=["a"]), k=0)
    with pytest.raises(ValueError):
        fusion.resolve_mode("graph")
    assert fusion.resolve_mode(None) == "hybrid" and fusion.resolve_mode("Dense") == "dense"


def vectors(n, dim, seed):
    r = random.Random(seed)
    return [(f"v{i:03}", [r.choice([-1.0, 0.0, 1.0]) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("most", [2_000_000, 8])
def test_dense(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "BLOCK_COMPONENTS", most)
    vs, qs = vectors(40, 4, 1), vectors(5, 4, 2)
    got = dense.search(spark.createDataFrame(vs, "chunk_id string, embedding array<float>"), spark.createDataFrame(qs, "qid string, embedding array<float>"), 7)
    got = {(r.qid, r.rank): (r.chunk_id, r.l2_distance) for r in got.collect()}
    for qid, q in qs:
        best = sorted((sum((x - y) ** 2 for x, y in zip(v, q, strict=True)), c) for c, v in vs)[:7]
        assert [got[qid, i + 1] for i in range(7)] == [(c, d) for d, c in best]
    with pytest.raises(Exception, match="lacks its chunk_id"):
        dense.search(spark.createDataFrame([(None, [1.0])], "chunk_id string, embedding array<float>"), spark.createDataFrame([("q", [1.0])], "qid string, embedding array<float>"), 1).collect()


def test_near_ties(spark):
    hits = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.1 + 1e-8), ("q", 3, None), ("q", 4, 0.5), ("q", 5, 0.5)], "qid string, rank int, l2_distance double")
    assert dense.near_ties(hits, 5).first().near_ties == 2
    assert dense.near_ties(hits, 4).first().near_ties == 1


def test_hybrid_agrees_with_rrf(spark, index):
    v = spark.createDataFrame([(c, [float(i), 1.0]) for i, (c, _) in enumerate(CORPUS)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "tidal blocks", [2.0, 1.0])], "qid string, text string, embedding array<float>")
    a = fusion.hybrid(index, v, q, 4).orderBy("rank").collect()
    arms = fusion.arms(dense.search(v, q, 50), bm25.search(index, q.select("qid", "text"), 50))
    b = fusion.rrf(arms).orderBy("rank").limit(4).collect()
    assert [(r.chunk_id, r.rrf_score) for r in a] == [(r.chunk_id, r.rrf_score) for r in b]
    assert {r.found_by for r in a} <= {"both", "dense", "bm25"}
    assert fusion.same_rankings(fusion.hybrid(index, v, q, 4), fusion.hybrid(index, v, q, 4))


def test_chunks(spark):
    words = [f"w{i}" for i in range(1000)]
    pages = spark.createDataFrame([("X.pdf", 0, " ".join(words)), ("X.pdf", 1, "one two"), ("dir\\Y.PDF", 0, "a"), ("Z.pdf", 0, " \n ")], "source string, page int, page_content string")
    rows = chunking.chunk(pages).orderBy("arxiv_id", "page", "ordinal").collect()
    assert [r.chunk_id for r in rows] == ["X::p0::c0", "X::p0::c1", "X::p0::c2", "X::p1::c0", "Y::p0::c0"]
    assert rows[1].page_content.split() == words[450:950] and rows[2].page_content.split() == words[900:]
    near = {(r.chunk_id, r.neighbour_id) for r in chunking.neighbours(chunking.chunk(pages)).collect()}
    assert near == {("X::p0::c0", "X::p0::c1"), ("X::p0::c1", "X::p0::c0"), ("X::p0::c1", "X::p0::c2"), ("X::p0::c2", "X::p0::c1")}
    assert [r.chunk_id for r in chunking.browse(chunking.chunk(pages), "X", 0).collect()] == ["X::p0::c0", "X::p0::c1", "X::p0::c2"]
    for bad in [(None, 0, "x"), ("X.pdf", None, "x")]:
        with pytest.raises(Exception, match="lacks"):
            chunking.chunk(spark.createDataFrame([bad], "source string, page int, page_content string")).collect()
    with pytest.raises(Exception, match="duplicate"):
        chunking.guard_unique(spark.createDataFrame([("a",), ("a",)], "chunk_id string")).collect()
    with pytest.raises(ValueError):
        chunking.windows(F.col("x"), 10, 10)


def test_fingerprint():
    a = chunking.fingerprint([("b", "2"), ("a", None)])
    assert a == chunking.fingerprint([("a", ""), ("b", "2")]) and a.startswith("sha256:")
    assert a != chunking.fingerprint([("a", ""), ("b", "2")], size=400)


@pytest.mark.parametrize("variant", ["lucene", "okapi"])
def test_search_by_documents_equals_the_join(spark, tmp_path, monkeypatch, variant):
    """Frequent words, copies that tie, terms of weight 0 or less, a question of no known word, tiny blocks."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words[: r.randint(1, 40)]) for _ in range(r.randint(0, 30))) for _ in range(150)]
    corpus = spark.createDataFrame([(f"c{i}", texts[i % 120 if i % 3 else 7]) for i in range(300)], "chunk_id string, text string")
    index = bm25.build(corpus, variant=variant).save(str(tmp_path))
    q = spark.createDataFrame([(f"q{i}", " ".join(r.choice(words) for _ in range(1 + i % 9)) + " w0 w0") for i in range(30)] + [("none", "zebra")], "qid string, text string")
    rows = lambda k: sorted(tuple(x) for x in bm25.search(index, q, k).collect())
    wanted = {k: rows(k) for k in (1, 7, 1000)}
    assert bm25._best_of_texts(index, q, 7) is None
    monkeypatch.setattr(bm25, "JOINED_MATCHES", 0)
    monkeypatch.setattr(bm25, "SCORES_AT_ONCE", 400)
    assert bm25._best_of_texts(index, q, 7) is not None
    assert {k: rows(k) for k in wanted} == wanted
    assert len([x for x in rows(7) if x[0] == "q1"]) == 7


def test_explain_small_equals_the_join(spark, index, monkeypatch):
    q = spark.createDataFrame([("q0", "granite blocks blocks zebra"), ("q1", "tidal night")], "qid string, text string")
    pairs = bm25.search(index, q, 2).select("qid", "chunk_id")
    few = [tuple(r) for r in bm25.explain(index, q, pairs).collect()]
    monkeypatch.setattr(bm25, "BROADCAST_PAIRS", 0)
    assert few and [tuple(r) for r in bm25.explain(index, q, pairs).collect()] == few


def test_index_without_buckets_searches_alike(spark, index, tmp_path):
    plain_index = bm25.build(spark.createDataFrame(CORPUS, "chunk_id string, text string")).save(str(tmp_path), bucketed=False)
    q = ["granite blocks", "tow-boat scale", "zebra", "blocks blocks"]
    assert ask(spark, plain_index, *q) == ask(spark, index, *q) and not (tmp_path / "postings").exists()
    rows = lambda i: sorted(tuple(r) for r in i.postings.select("term", "chunk_id", "tf", "dl", "bucket").collect())
    assert rows(plain_index) == rows(index) and plain_index.terms.count() == index.terms.count()


def _never(*_):
    raise AssertionError("words as rows or arrays of the JVM")


def test_index_counts_terms_in_batches(spark, monkeypatch):
    rows = [("a", "Tow-boat tow boat \u00c9t\u00e9"), ("b", ""), ("c", "ete_2 ete"), ("d", None)]
    docs = spark.createDataFrame(rows, "chunk_id string, text string")
    by_tokens = bm25.build(docs, tokens=T.tokenize(F.col("text")))
    monkeypatch.setattr(T, "tokenize", _never)
    monkeypatch.setattr(bm25, "TEXTS_AT_ONCE", 1)
    index = bm25.build(docs)
    for name in ("postings", "docs", "counts", "stats"):
        assert sorted(map(repr, getattr(index, name).collect())) == sorted(map(repr, getattr(by_tokens, name).collect()))


@pytest.mark.parametrize("size,overlap", [(5, 2), (3, 0), (500, 50)])
def test_white_windows_equal_those_of_words(spark, monkeypatch, size, overlap):
    r = random.Random(2)
    words = lambda n: "".join(r.choice(["a", "\u00e9\u4e2d", "x\u00a0y", "\x1c"]) + r.choice([" ", "\n", " \t", "\x0b\f\r"]) for _ in range(n))
    texts = [None, "", " \n", *(r.choice(["", " "]) + words(n) for n in (*range(1, 14), 499, 500, 501, 951))]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, page_content string")
    want = chunking.split_pages(pages, T.white_tokens(F.col("page_content")), size, overlap).collect()
    monkeypatch.setattr(T, "white_tokens", _never)
    assert sorted(chunking.split_pages(pages, None, size, overlap).collect()) == sorted(want)
