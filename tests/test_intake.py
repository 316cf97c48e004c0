import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chat, corpus
from plumbline.sources import files, store
from plumbline.streaming import ingest


def test_graph(spark):
    c = spark.createDataFrame([("a", ["b", "c", "a", "zz"]), ("b", ["a", "a"]), ("c", []), ("d", None)], "arxiv_id string, ref_arxiv_ids array<string>")
    e = corpus.edges(c)
    assert {tuple(r) for r in e.collect()} == {("a", "b"), ("a", "c"), ("b", "a")}
    d = corpus.degrees(c, e)
    assert {r.arxiv_id: r.degree for r in d.collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}
    assert corpus.isolated(d).first()[0] == 1
    keep = spark.createDataFrame([("a",), ("b",)], "arxiv_id string")
    kept, dropped = corpus.curate(c, keep)
    assert {r.arxiv_id for r in kept.collect()} == {"a", "b"} and {r.arxiv_id for r in dropped.collect()} == {"c", "d"}
    assert {tuple(r) for r in corpus.induced(e, keep).collect()} == {("a", "b"), ("b", "a")}


def test_candidates(spark):
    c = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("b", "2020-01-01T00:00:00Z"), ("c", "soon"), ("a", "2024-01-01T00:00:00Z")], "arxiv_id string, published string")
    cut = corpus.cutoff(F.to_timestamp(F.lit("2024-06-01 00:00:00")), 1)
    assert sorted(r.arxiv_id for r in corpus.recent(c, cut).collect()) == ["a", "c"]
    assert [r.arxiv_id for r in corpus.recent(c, cut, 1).collect()] == ["a"]
    refs = spark.sql("select array(named_struct('externalIds', map('ArXiv', 'b')), named_struct('externalIds', map('ArXiv', 'a')), named_struct('externalIds', map('DOI', 'x')), named_struct('externalIds', cast(null as map<string,string>)), null) as r")
    assert refs.select(corpus.references(F.col("r"))).first()[0] == ["a", "b"]
    found = spark.createDataFrame([("a", 7, ["b"])], "arxiv_id string, citation_count int, ref_arxiv_ids array<string>")
    rows = {r.arxiv_id: r for r in corpus.annotate(c.dropDuplicates(), found).collect()}
    assert rows["a"].s2_found and rows["a"].citation_count == 7 and not rows["b"].s2_found and rows["b"].ref_arxiv_ids == []
    anchors = spark.createDataFrame([("a", "x")], "arxiv_id string, published string")
    assert corpus.with_anchors(anchors, c).where("arxiv_id = 'a'").count() == 1


def test_manifest(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "arxiv_id string")
    got = spark.createDataFrame([("x/a.pdf", b"abc", None), ("b.pdf", None, "timeout")], "path string, content binary, error string")
    m = corpus.manifest(papers, got)
    rows = {r.arxiv_id: (r.status, r.file_size_bytes, r.error) for r in m.collect()}
    assert rows == {"a": ("ok", 3, None), "b": ("download_failed", None, "timeout"), "c": ("download_failed", None, "missing")}
    assert tuple(corpus.manifest_totals(m).first()) == (1, 2, 3)


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2401.01234v2</id><title> A
title</title><summary>S</summary><published>2024-01-01T00:00:00Z</published><author><name>N One</name></author><author><name>N Two</name></author>
<arxiv:primary_category term="cs.IR"/><link href="http://x/abs" rel="alternate"/><link title="pdf" href="http://x/pdf"/></entry>
<entry><id>http://arxiv.org/abs/2402.00001v1</id><title>B</title><published>2024-02-01T00:00:00Z</published><author><name>N</name></author><link href="http://x/abs"/></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    a, b = files.read_feed(spark, str(tmp_path / "f.xml")).orderBy("arxiv_id").collect()
    assert (a.arxiv_id, a.title, a.authors, a.primary_category, a.pdf_url) == ("2401.01234", "A title", ["N One", "N Two"], "cs.IR", "http://x/pdf")
    assert (b.arxiv_id, b.primary_category, b.pdf_url, b.summary) == ("2402.00001", "", "https://arxiv.org/pdf/2402.00001", "")


def test_services(spark):
    service = [{"arxiv_id": f"p{i % 7}"} for i in range(12)]
    page = lambda at, n: service[at : at + n]
    assert [(e.pos, e.arxiv_id) for e in files.paged(spark, page, 100, 5).orderBy("pos").collect()] == [(i, f"p{i}") for i in range(7)]
    assert files.paged(spark, page, 3, 5).count() == 3 and files.paged(spark, page, 0).count() == 0
    dated = [{"arxiv_id": str(i), "published": p} for i, p in enumerate(["2020-01-01T00:00:00Z", "2024-05-01T00:00:00Z", "soon", None])]
    assert sorted(e.arxiv_id for e in files.paged(spark, lambda at, n: dated[at : at + n], 4, 3, cutoff="2022-01-01").collect()) == ["1", "2", "3"]

    def post(ids):
        return None if "bad" in ids else [None if i == "miss" else {"citationCount": len(i)} for i in ids]

    ids = spark.createDataFrame([("aa",), ("miss",), ("bad",)], "arxiv_id string").coalesce(1)
    rows = {r.arxiv_id: (r.found, r.body) for r in files.lookup(ids, post, size=2).collect()}
    assert rows == {"aa": (True, '{"citationCount": 2}'), "miss": (False, None), "bad": (False, None)}


def test_uploads(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "a.pdf").write_bytes(b"three")
    up = files.uploads(spark, str(tmp_path / "*.pdf"))
    pages = files.pages(up, lambda data: data.decode().split("\f"))
    assert {(r.source.rsplit("/", 1)[1], r.page, r.page_content) for r in pages.collect()} == {("b.pdf", 0, "one"), ("b.pdf", 1, "two"), ("a.pdf", 0, "three")}
    (tmp_path / "c.PDF").write_bytes(b"x")
    with pytest.raises(Exception, match="not a .pdf"):
        files.uploads(spark, str(tmp_path / "*")).collect()


def test_runs(spark, tmp_path):
    scores = spark.createDataFrame([("q1", [1.0, None], 0.5)], "qid string, coverage_ranks array<double>, rr double")
    files.write_run(scores, scores.select("rr"), {"k": 1}, str(tmp_path / "r"))
    back = files.read_run(spark, str(tmp_path / "r"), "qid string, coverage_ranks array<double>, rr double, gold_hits map<string,string>").first()
    assert back.coverage_ranks == [1.0, None] and back.gold_hits is None
    assert files.read_meta(spark, str(tmp_path / "r")) == {"k": 1} and files.read_meta(spark, str(tmp_path / "none")) == {}
    files.write_run(scores.limit(0), scores.select("rr"), {}, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        files.read_run(spark, str(tmp_path / "e"), scores.schema)


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), files.PAGE)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        s.read()
    assert not s.exists()
    s.create()
    assert s.exists() and s.count("local") == 0
    first = pages_of(spark, ("a.pdf", 0, "one two"), ("b.pdf", 0, "three"))
    rows = ingest.to_rows(first, "local", ingest.hashed_embedding)
    assert s.missing(rows).count() == 2
    s.upsert(rows)
    s.upsert(rows)
    assert s.count("local") == 2 and s.missing(rows).isEmpty()
    ingest.ingest(pages_of(spark, ("a.pdf", 0, "changed")), s, "local")
    assert {r.chunk_id: r.page_content for r in s.read("local").collect()} == {"a::p0::c0": "changed", "b::p0::c0": "three"}
    ingest.ingest(pages_of(spark, ("a.pdf", 0, "other")), s, "remote")
    assert s.count("local") == 2 and s.count("remote") == 1
    s.reset()
    assert not s.exists()


def test_last_of_a_batch_wins(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    ingest.ingest(pages_of(spark, ("a.pdf", 0, "x")), s, "local")
    rows = [ingest.to_rows(pages_of(spark, ("a.pdf", 0, t)), "local", ingest.hashed_embedding) for t in ("zz early", "aa late")]
    s.upsert(rows[0].union(rows[1]))
    assert [r.page_content for r in s.read("local").collect()] == ["aa late"]


def test_killed_and_competing_writers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    put = lambda name, text: ingest.ingest(pages_of(spark, (name, 0, text)), s, "local")
    put("a.pdf", "one")

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_publish", killed)  # dies between writing rows and publishing them
        with pytest.raises(Killed):
            put("b.pdf", "lost")
    assert s.count("local") == 1
    put("b.pdf", "two")
    assert s.count("local") == 2 and len(list((tmp_path / "s/data").iterdir())) == 3
    s.clean(orphan_seconds=0)
    assert s.count("local") == 2 and len(list((tmp_path / "s/data").iterdir())) == 2

    publish, others = store.Store._publish, []

    def beaten(self, number, snapshot):
        if not others:
            others.append(1)
            other = store.Store(spark, self.path)
            ingest.ingest(pages_of(spark, ("c.pdf", 0, "three")), other, "local")
        return publish(self, number, snapshot)

    monkeypatch.setattr(store.Store, "_publish", beaten)
    put("d.pdf", "four")
    assert {r.arxiv_id for r in s.read("local").collect()} == {"a", "b", "c", "d"}


def test_old_snapshots_go_and_untouched_buckets_stay(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=8)
    ingest.ingest(pages_of(spark, *[(f"p{i}.pdf", 0, f"text {i}") for i in range(60)]), s, "local")
    first = s._snapshot(s.version)["gens"]
    for i in range(5):
        ingest.ingest(pages_of(spark, ("p1.pdf", 0, f"again {i}")), s, "local")
    last = s._snapshot(s.version)["gens"]
    assert sum(last[b] != first[b] for b in first) == 1 and s.count("local") == 60
    assert len(list((tmp_path / "s/snapshots").glob("*.json"))) == store.KEPT
    assert len(list((tmp_path / "s/data").iterdir())) == 1 + store.KEPT


def test_chunks_without_ids(spark):
    rows = spark.createDataFrame([(None, "same", "local"), ("", "same", "local"), (None, "other", "local")], "chunk_id string, page_content string, provider string")
    assert store.merge(None, rows).count() == 2


def test_watch(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    land = tmp_path / "land"
    land.mkdir()
    changes = []
    go = lambda: ingest.watch(spark, str(land), s, "local", str(tmp_path / "cp"), on_change=lambda: changes.append(1)).awaitTermination(120)
    (land / "1.json").write_text('{"source": "a.pdf", "page": 0, "page_content": "x y"}\n')
    go()
    go()
    (land / "2.json").write_text('{"source": "a.pdf", "page": 0, "page_content": "x y"}\n{"source": "c.pdf", "page": 0, "page_content": "z"}\n')
    go()
    assert s.count("local") == 2 and len(changes) == 2


def test_chat(spark, tmp_path):
    assert chat.ping() == "ok" and "Groq" in chat.providers() and chat.models("gemini")
    with pytest.raises(ValueError):
        chat.models("x")
    with pytest.raises(ValueError):
        chat.check_model("groq", "x")
    q = spark.createDataFrame([("q1", "why"), ("q2", "how")], "qid string, text string")
    hits = spark.createDataFrame([("q1", 2, "second"), ("q1", 1, "first")], "qid string, rank int, page_content string")
    rows = {r.qid: r for r in chat.answer(q, hits, lambda p: p.str.upper(), True).collect()}
    assert "FIRST\n\nSECOND" in rows["q1"].answer and rows["q2"].contexts == []
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "d")], "conv_id int, turn int, role string, text string")
    turns = chat.turns(talk)
    assert {tuple(r) for r in turns.collect()} == {(1, 0, "a", "b"), (1, 2, "c", None), (2, 0, "d", None)}
    assert {tuple(r) for r in chat.undo(turns).collect()} == {(1, 0, "a", "b")}
    log = spark.createDataFrame([("q", 'a,"b"', "p", "m", ["x", "y"], datetime.datetime(2024, 1, 2, 3, 4, 5))], "question string, answer string, provider string, model string, pdf_names array<string>, ts timestamp")
    files.write_chat(log, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape="\\").first().pdf_names == "x, y"


def test_review(spark, tmp_path):
    c = spark.createDataFrame([("a", "t", "2024-01-01", "s", 0), ("b", "u", None, "s", 1)], "arxiv_id string, title string, published string, source string, pos int")
    d = spark.createDataFrame([("a", 1), ("b", 1)], "arxiv_id string, degree long")
    lines = [r.line for r in corpus.review(c, d).orderBy("place").collect()]
    assert lines == ["| a | s | 2024 | 1 | t |", "| b | s |  | 1 | u |"]
    files.write_lines(corpus.review(c, d), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == lines
    query = spark.range(1).select(T.query_string(F.array(F.struct(F.lit("a").alias("name"), F.lit("x y").alias("value"))))).first()[0]
    assert query == "a=x+y"
