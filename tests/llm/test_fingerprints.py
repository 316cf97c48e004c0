"""Fingerprints: read back from their strings alone, by a plain version of the sketch."""

import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, fingerprints

KEY = (1 << 48) - 1


def hashed(*values):
    """Spark's xxhash64 of longs (8 bytes) and ints (4 bytes): the hash of one value is the seed of the next."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64(struct.pack("<q" if size == 8 else "<i", v), seed=seed).intdigest()
    return seed


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def sketch(text, width=64):
    """A fingerprint's digests, as peeling its blocks one by one recovers them."""
    n, level, *blocks = text.split(" ")
    out = set()
    for b in blocks:
        name, cells = b.split("=")
        block, attempt, sub = map(int, name.split("."))
        held = {int(i): [int(c), int(v, 16)] for i, c, v in (x.split(".") for x in cells.split(","))}
        places = lambda v: [width * t + (hashed((signed(v), 8), (attempt, 4)) >> 6 * t & width - 1) for t in range(3)]
        while True:
            pure = [v for i, (c, v) in held.items() if c == 1 and v >> 48 == hashed((v & KEY, 8), (97, 4)) >> 48 and i in places(v)]
            if not pure:
                break
            out.add(pure[0])
            assert pure[0] & (1 << int(level)) - 1 == block and hashed((signed(pure[0]), 8), (attempt, 4)) >> 32 & (1 << attempt) - 1 == sub
            for i in places(pure[0]):
                held[i][0] -= 1
                held[i][1] ^= pure[0]
        assert not any(c or v for c, v in held.values())
    assert len(out) == int(n)
    return out


def checked(rows):
    """Everything that the strings tell of rows (doc_id, text, the operator's row) in the order of doc_id."""
    for i, (_, t, r) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        half = len(t) // 2
        new = t[: len(t) - half] + after[1][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = sketch(r.fingerprint), sketch(r.edited_fingerprint), sketch(after[2].fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=1e-12)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c), abs=1e-12)
        assert (r.near_next == 1) == (t == after[1]) and (r.near_edited == 1) == (t == new)


def test_strings_alone_give_the_likeness(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    rows = [(d, t, got[d]) for d, t in texts]
    checked(rows)
    prints = {}
    for _, t, r in rows:
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_order_and_repeats_of_lines_count(spark):
    texts = ["alpha beta\ngamma delta", "gamma delta\nalpha beta", "gamma delta\nalpha beta\nalpha beta", "same  line", "same line"]
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert len({r.fingerprint for r in rows}) == 5
    assert [round(r.near_next, 9) for r in rows] == [round(x, 9) for x in (2 / 4, 2 / 5, 0, 0, 0)]
    checked([(i, t, r) for i, (t, r) in enumerate(zip(texts, rows, strict=True))])


def test_blocks_that_do_not_peel_are_laid_out_larger(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    want = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprints.fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprints, "WIDTH", 4)
    got = fingerprints.fingerprints(docs).collect()
    assert {r.doc_id: (r.near_edited, r.near_next) for r in got} == want
    assert any(int(b.split("=")[0].split(".")[1]) for r in got for b in r.fingerprint.split(" ")[2:])
    for r in got:
        sketch(r.fingerprint, 4), sketch(r.edited_fingerprint, 4)


def test_outliers_and_missing_ids_do_not_gather_in_one_group(spark):
    ids = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = ids.union(spark.createDataFrame([(1 << 60, "far"), (-(1 << 60), "far"), ((1 << 63) - 1, "last")], "doc_id long, text string"))
    groups = fingerprints.neighbours(docs, common.Scratch(spark, "t")).groupBy("x").count().collect()
    assert sum(r["count"] for r in groups) == 3003 and len(groups) > 30 and max(r["count"] for r in groups) < 250


def test_rows_that_repeat_follow_each_other(spark):
    docs = spark.createDataFrame([(None, "none a b")] * 40 + [(7, "seven")] * 30 + [(8, "eight")], "doc_id long, text string")
    rows = fingerprints.fingerprints(docs).collect()
    near = lambda d: sorted(r.near_next for r in rows if r.doc_id == d)
    assert len(rows) == 71 and near(7) == [0] + [1] * 29 and near(None) == [0] + [1] * 39 and near(8) == [0]
    edited = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    assert {r.edited_sha256 for r in rows if r.doc_id is None} == {edited("none a b", "none a b"), edited("none a b", "seven")}
