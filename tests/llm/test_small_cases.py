"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints, langid, minhash, mixing, mtree, packing, quality, sharding, spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, dup int, rank int, shard int, score string, node long, x string, removed int, lang_pred string"
LONG = " ".join(f"word{i % 5000} runs on." for i in range(40_000))
ROWS = [
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \n\t ", None, None),
    (4, "The same words as ever were written here.", "en", "s1"),
    (5, "The same words as ever were written here.", "en", "s2"),
    (5, "The same words as ever were written here.", "en", "s2"),
    (6, "un deux trois", "fr", "http://host.example/path/page"),
    (7, "12345 !!! ???", None, "s2"),
    (8, "one", "en", None),
    (None, "A row that has no number of its own.", "en", "s1"),
    (9, LONG, "en", "s1"),
    (10, "x" * 200_000, "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 2, 3, "s", 4, "x", 5, "l") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_minhash(docs, empty):
    got = by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(4, 4, True)] and got[5] == [(4, 4, False)] * 2
    assert got[6] == [(1, 6, True)] and got[8] == [(1, 8, True)] and got[10] == [(1, 10, True)]
    assert got[None][0][0] == 5 and len(got) == 11
    assert minhash.near_duplicates(empty).count() == 0


def test_spans(docs, empty, spark):
    out = spans.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "removed"] + ["removed", "n_removed"] and out.count() == len(ROWS)
    got = by_id(out, "text", "n_removed")
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[5] == [(ROWS[4][1], 0)] * 2
    assert got[9][0][1] > 30_000  # the text repeats itself
    assert spans.remove_repeats(empty).count() == 0
    passage = "First comes a sentence of several words. Then a second one follows it at once. A third one closes the passage with some more words. So it ends here, at last, after many words."
    three = spark.createDataFrame([(3, f"Head of three.\n{passage}\nTail of three."), (1, f"Head of one.\n{passage}\nTail of one."), (2, f"{passage}"), (4, "Short. Short. Short.")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in spans.remove_repeats(three).collect()}
    assert texts == {1: f"Head of one.\n{passage}\nTail of one.", 2: "", 3: "Head of three.\nTail of three.", 4: "Short. Short. Short."}
    cut = {r.doc_id: [tuple(s) for s in r.removed] for r in spans.remove_repeats(three).collect()}
    assert cut[3] == [(15, 15 + len(passage) + 1)] and cut[1] == []


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    size = {}
    for r in got:
        size.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in size.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    one = [r for r in got if r.doc_id == 1]
    assert [(r.piece, r.start, r.length, r.ids_crc32) for r in one] == [(0, 0, 1, zlib.crc32(b"\0\0\0\0"))]
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    long = sorted(r.piece for r in got if r.doc_id == 9)
    assert long == list(range(len(long))) and len(long) > 50
    assert packing.pack(empty).count() == 0


def test_mixing(docs, empty):
    d, draws = mixing.mix(docs, block_words=100)
    assert d.count() == len(ROWS)
    drawn = {(r.key, r.dup): r.words for r in draws.groupBy("key", "dup").agg(F.sum("words").alias("words")).collect()}
    rows = d.collect()
    taken = {}
    for r in rows:
        words = drawn.get((r.key, r.dup), 0)
        assert words <= 2 * r["size"]
        taken.setdefault((r.source, r.target), 0)
        taken[r.source, r.target] += words
    assert all(t - 1 < got <= t for (_, t), got in taken.items())
    assert abs(sum(t for _, t in taken) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert len({(r.key, r.dup) for r in rows}) == len(rows)
    out = mixing.mixed_texts(docs, block_words=100)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(drawn.values())
    assert out.where("n_chars <> length(text)").isEmpty()
    assert mixing.mixed_texts(empty).count() == 0 and mixing.mix(empty)[0].count() == 0


def test_language(docs, empty):
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    out = langid.identify(docs, model)
    got = by_id(out, "lang_pred", "score")
    assert got[1] == got[2] == got[3] == got[7] == [("und", 0.0)]
    assert got[6][0][0] == "fr" and got[9][0][0] == "en" and out.count() == len(ROWS)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(by_id(kept, "text"), key=str) == sorted([4, 5, 6, 8, 9, 10, None], key=str)
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert none.languages == [] and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in (1, 2, 4, 5, 6, 8, 9)] + [(4, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.rate(docs, model)
    assert out.count() == len(ROWS) and out.where("score is null or score < 0 or score > 1").isEmpty()
    got = by_id(out, "score")
    assert got[1] == got[2] == got[7]
    blank = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.rate(docs, blank).collect()} == {0.1}
    assert toxicity.rate(empty, blank).count() == 0 and toxicity.fit(empty, labels).intercept < 0


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 4, 5, 6, 8, 9)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, quality.fit(docs, labels))
    assert out.count() == len(ROWS) and out.where("score is null or score <= 0 or score >= 1").isEmpty()
    assert by_id(out, "host", "path")[6] == [("host.example", "path/page")]
    assert quality.judge(empty, quality.fit(docs, labels.limit(0))).count() == 0
    even = quality.judge(docs, quality.fit(docs, labels.limit(0)))
    assert {round(r.evidence, 9) for r in even.collect()} == {0.5}


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_sharding(docs, shards):
    rows = sharding.shard(docs, shards).collect()
    counts = [0] * shards
    for r in rows:
        counts[r.shard] += 1
    assert len(rows) == len(ROWS) and max(counts) - min(counts) <= 1
    for i in range(shards):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(counts[i]))
    got = {r.doc_id: (r["size"], r.text_crc32) for r in rows}
    assert got[1] == (1, 0) and got[10] == (200_001, zlib.crc32(b"x" * 200_000))


def test_sharding_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


def test_fingerprints(docs, empty, spark):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].n_chars == 0 and got[1].near_edited == 1 and got[1].fingerprint == got[2].fingerprint
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1
    alone = fingerprints.fingerprints(spark.createDataFrame([(7, "ab\ncd")], "doc_id long, text string")).first()
    assert alone.near_next == 1 and alone.n_chars == 5
    assert fingerprints.fingerprints(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.25])]
    v = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, query_id int")
    got = {}
    for r in mtree.top_k(v, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got[0] == [(1, 1, 2048), (2, 2, 2048), (3, 8, 2048)]
    assert got[20][0] == (1, 7, 0) and len(got) == 2
    assert mtree.top_k(v.limit(0), F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-1 << 24, 1 << 24, (60, 5))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    x = 64 * x
    for r in mtree.top_k(v, F.col("vec_id") < 5, 4).collect():
        order = sorted((-int(x[r.query_id] @ x[i]), i) for i in range(60) if i != r.query_id)
        assert (-r.score, r.vec_id) == order[r["rank"] - 1]
