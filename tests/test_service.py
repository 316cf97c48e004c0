"""What a user of the library calls, against plain versions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bm25, calls, chat, corpus, evaluate, generation, golden, metrics, planning, ranks, report
from plumbline.operators.retriever import Retriever
from plumbline.sources import files, saved, store
from plumbline.streaming import ingest

TEXTS = ["granite blocks carried by boats", "slate and granite weighed", "tidal ledgers kept at night", "boats at night"]


def collection(spark, path, provider="groq"):
    s = store.Store(spark, str(path), buckets=4)
    pages = spark.createDataFrame([(f"d{i}.pdf", 0, t) for i, t in enumerate(TEXTS)], files.PAGE)
    ingest.ingest(pages, s, provider)
    return s


def ask(spark, *texts):
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, text string")
    return q.withColumn("embedding", ingest.hashed_embedding(F.col("text")))


def test_retriever_follows_its_store(spark, tmp_path):
    s = collection(spark, tmp_path / "s")
    r = Retriever.of(s, "groq")
    hits = r.search(ask(spark, "granite"), k=2).orderBy("rank").collect()
    assert len(hits) == 2 and hits[0].page_content in TEXTS[:2] and hits[0].arxiv_id in ("d0", "d1")
    found = r.search(ask(spark, "granite"), details=True).where("found_by <> 'dense'").collect()
    assert {h.chunk_id for h in found} == {"d0::p0::c0", "d1::p0::c0"}
    ingest.ingest(spark.createDataFrame([("new.pdf", 0, "granite granite granite")], files.PAGE), s, "groq")
    assert Retriever.of(s, "groq").search(ask(spark, "granite"), details=True).where("bm25_score is not null").count() == 3
    assert r.search(ask(spark, "granite"), details=True).where("bm25_score is not null").count() == 2
    for i in range(3):
        ingest.ingest(spark.createDataFrame([("new.pdf", 0, f"again {i}")], files.PAGE), s, "groq")
        Retriever.of(s, "groq")
    assert len(list((tmp_path / "s/index/groq").iterdir())) == 2
    assert Retriever.of(s, "groq").deterministic(ask(spark, "granite", "boats"))
    with pytest.raises(ValueError, match="no collection"):
        Retriever.of(s, "gemini")
    with pytest.raises(ValueError, match="unknown retrieval mode"):
        r.search(ask(spark, "x"), mode="graph")


def test_a_hit_needs_its_chunk_id(spark):
    vectors = spark.createDataFrame([("", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    payload = spark.createDataFrame([("", "text")], "chunk_id string, page_content string")
    q = spark.createDataFrame([("q", "x", [1.0, 0.0])], "qid string, text string, embedding array<float>")
    with pytest.raises(Exception, match="lacks its chunk_id"):
        Retriever(None, vectors, payload).search(q, mode="dense").collect()


def test_chat_retrieves_then_answers(spark, tmp_path):
    r = Retriever.of(collection(spark, tmp_path / "s"), "groq")
    q = ask(spark, "granite blocks")
    got = chat.respond(r, q, "groq", "openai/gpt-oss-20b", lambda p: p.str.upper(), mode="dense", include_context=True).first()
    assert len(got.contexts) == 3 and got.contexts[0] in TEXTS and "GRANITE BLOCKS" in got.answer and got.contexts[0].upper() in got.answer
    for bad in (("nobody", "x"), ("groq", "x")):
        with pytest.raises(ValueError):
            chat.respond(r, q, *bad, lambda p: p)


def question(qid, *groups, semantics="any_of"):
    return {"qid": qid, "question": "granite", "semantics": semantics, "gold_groups": [{"chunk_ids": list(g), "note": None} for g in groups], "expected_answer": None, "source_papers": [], "provenance": "p", "tags": [], "chunk_text_sha8": {}}


def test_evaluate(spark, tmp_path):
    r = Retriever.of(collection(spark, tmp_path / "s"), "groq")
    qs = spark.createDataFrame([{"pos": i} | q for i, q in enumerate([question("a", ["d0::p0::c0"]), question("b", ["d2::p0::c0"], ["d1::p0::c0"], semantics="all_required"), question("c", ["gone::p0::c0"])])], f"pos int, {golden.QUESTIONS}")
    vectors = qs.select("qid", ingest.hashed_embedding(F.col("question")).alias("embedding"))
    with pytest.raises(ValueError, match="UNKNOWN_CHUNK_ID"):
        evaluate.evaluate(r, qs, vectors)
    run = evaluate.evaluate(r, qs, vectors, allow_unknown=True, version="v1")
    scores = {x.qid: x for x in run.scores.collect()}
    hits = {x.chunk_id: x for x in r.search(vectors.where("qid = 'a'").withColumn("text", F.lit("granite")), 50, details=True).collect()}
    assert set(scores) == {"a", "b"} and run.meta["n_questions"] == 2
    assert scores["a"].rr == 1 / hits["d0::p0::c0"]["rank"]
    assert scores["b"].rr == 1 / max(hits[c]["rank"] for c in ("d2::p0::c0", "d1::p0::c0"))
    d = {x.qid: x for x in run.details.collect()}["b"]
    assert d.top10 == [h.chunk_id for h in sorted(hits.values(), key=lambda h: h["rank"])][:10] and d.gold_chunk_ids == ["d1::p0::c0", "d2::p0::c0"]
    assert {g.chunk_id: g.found_by for g in d.gold_hits} == {c: hits[c].found_by for c in d.gold_chunk_ids} and len(d.top10_distances) == len(d.top10)
    assert [x.qid for x in evaluate.evaluate(r, qs, vectors, qids=["b", "a"], first=1, allow_unknown=True).scores.collect()] == ["a"]
    with pytest.raises(ValueError, match="no questions"):
        evaluate.evaluate(r, qs, vectors, qids=["z"], allow_unknown=True)
    with pytest.raises(ValueError, match="FINGERPRINT"):
        evaluate.evaluate(r, qs, vectors, fingerprints=("x", "y"), allow_unknown=True)
    run.save(str(tmp_path / "run"))
    back = {x.qid: x for x in files.read_run(spark, str(tmp_path / "run")).collect()}
    assert back["a"].rr == scores["a"].rr and back["b"].top10 == d.top10 and files.read_meta(spark, str(tmp_path / "run"))["golden_set_version"] == "v1"
    lines = [x.line for x in report.strata_lines(run.strata).orderBy("place").collect()]
    assert lines[0].startswith("all n=2 MRR=") and len(lines) == 13 and lines[-1].startswith("MRR_mean_groups=")
    assert report.log_row(run.strata, "v", "n").first().line.startswith("| v | ")


def test_decisions(spark):
    rows = [(f"q{i:02}", "any_of", float(i % 2), float(i % 2), float(i % 2), float(i % 2)) for i in range(20)]
    names = "qid string, semantics string, rr double, recall_at_5 double, sufficiency_at_5 double, ndcg_at_10 double"
    base = spark.createDataFrame(rows, names)
    better = base.withColumn("ndcg_at_10", F.lit(1.0))
    outcome = lambda *a: (lambda r: (r.outcome, r.code))(metrics.decide(*a, iters=100).first())
    v1, v2 = {"golden_set_version": "v1"}, {"golden_set_version": "v2"}
    assert outcome(base, better, v1, v1) == ("fires", 0)
    assert outcome(better, base, v1, v1) == ("stays", 1)
    assert outcome(base, better, v1, v2) == ("unusable", 2)
    assert outcome(base, better.withColumn("qid", F.concat(F.lit("x"), "qid")), v1, v1) == ("unusable", 2)
    lines = report.comparison_lines(metrics.compare(base, better, 50)).where("stratum = 'all' and metric = 'ndcg_at_10'").first().line
    assert lines.startswith("ndcg_at_10 0.5000 1.0000 +0.5000")


def test_the_last_line_of_a_question_counts(spark, tmp_path):
    (tmp_path / "per_question").mkdir()
    (tmp_path / "per_question/part-0.json").write_text("".join(json.dumps({"qid": q, "rr": rr}) + "\n" for q, rr in [("a", 0.1), ("b", 0.2), ("a", 0.3)]))
    (tmp_path / "per_question/part-1.json").write_text(json.dumps({"qid": "b", "rr": 0.9}) + "\n")
    assert {r.qid: r.rr for r in files.read_run(spark, str(tmp_path)).collect()} == {"a": 0.3, "b": 0.9}


def test_uploads_land_whole(spark, tmp_path):
    at = files.save_upload(spark, str(tmp_path), "a.pdf", b"one\ftwo")
    files.save_upload(spark, str(tmp_path), "a.pdf", b"three\ffour\ffive")
    assert at.endswith("/a.pdf") and (tmp_path / "a.pdf").read_bytes() == b"three\ffour\ffive"
    pages = files.pages(files.uploads(spark, str(tmp_path / "*.pdf")), lambda data: data.decode().split("\f"))
    assert pages.count() == 3
    for bad in ("a.txt", "x/a.pdf", "..\\a.pdf"):
        with pytest.raises(ValueError):
            files.save_upload(spark, str(tmp_path), bad, b"")


def test_json_documents(spark, tmp_path):
    files.write_json(spark, {"provider": "groq", "chunk_count": 3}, str(tmp_path / "m.json"))
    files.write_json(spark, {"provider": "groq", "chunk_count": 4}, str(tmp_path / "m.json"))
    assert files.read_json(spark, str(tmp_path / "m.json")) == {"provider": "groq", "chunk_count": 4} and files.read_json(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "c.json").write_text(json.dumps([{"arxiv_id": "a", "ref_arxiv_ids": ["b"]}, {"arxiv_id": "c", "title": "t"}], indent=1))
    rows = {r.arxiv_id: r for r in files.read_records(spark, str(tmp_path / "c.json"), files.CANDIDATES).collect()}
    assert rows["a"].ref_arxiv_ids == ["b"] and rows["a"].title is None and rows["c"].title == "t"
    report.write_sweep(spark, spark.createDataFrame([("k60", 0.5), ("k10", 0.4)], "config string, mrr double"), {"depth": 50}, str(tmp_path))
    sweep = json.loads((tmp_path / "sweep.json").read_text())
    assert [r["config"] for r in sweep["results"]] == ["k10", "k60"] and sweep["depth"] == 50


def test_calls():
    waits = []
    go = lambda *replies: calls.call(lambda p, it=iter(replies): (lambda r: (_ for _ in ()).throw(r) if isinstance(r, Exception) else r)(next(it)), "p", sleep=waits.append)
    assert go('x {"a": 1} y') == ("ok", {"a": 1}, "")
    assert go("nothing", '{"a": 2}') == ("ok", {"a": 2}, "")
    assert go(OSError("busy"), OSError("busy"), '{"a": 3}')[1] == {"a": 3} and waits == [5, 10]
    assert go(OSError("429: tokens per DAY"), '{"a": 1}')[0] == "quota" and waits == [5, 10]
    assert go("[1]", "no", "{bad}") == ("failed", None, "no JSON")


def test_history(spark):
    h = spark.createDataFrame([(1, 0, "a", "b"), (1, 2, "c", "d"), (2, 0, "e", "f")], "conv_id int, turn int, question string, answer string")
    new = spark.createDataFrame([(1, "g", "h", 2), (1, "i", "j", 1), (3, "k", "l", 1)], "conv_id int, question string, answer string, at int")
    rows = {(r.conv_id, r.turn): r.question for r in chat.append(h, new).collect()}
    assert rows == {(1, 0): "a", (1, 2): "c", (1, 3): "i", (1, 4): "g", (2, 0): "e", (3, 0): "k"}
    assert chat.clear(h, h.where("conv_id = 1")).count() == 1
    x = spark.createDataFrame([("p", "m", 1), (None, "m", 1), ("p", None, 1), ("p", "m", 0)], "p string, m string, n int")
    assert [r[0] for r in x.select(chat.ready(F.col("p"), F.col("m"), F.col("n"))).collect()] == [True, False, False, False]


def test_fetch_takes_what_is_there(spark):
    asked = []
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "arxiv_id string")
    present = spark.createDataFrame([("raw/a.pdf", b"x"), ("raw/b.pdf", b"")], "path string, content binary")

    def get(i):
        if i == "a":
            raise AssertionError("a is there")
        if i == "c":
            raise OSError("404")
        return b"new"

    rows = {T_stem(r.path): (bytes(r.content) if r.content else None, r.error) for r in corpus.fetch(papers, present, get).collect()}
    assert rows == {"a": (b"x", None), "b": (b"new", None), "c": (None, "404")} and not asked
    keep = lambda *ids: spark.createDataFrame([(i,) for i in ids], "arxiv_id string")
    assert sorted(r[0] for r in corpus.keep_set(keep("a", "b"), keep("b", None), keep("c")).collect()) == ["a", "b", "c"]


def T_stem(path):
    return path.rsplit("/", 1)[-1].removesuffix(".pdf")


def test_places(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.col("id").cast("string").alias("name"))
    name = F.col("name")
    kept, ranks.BUCKET_ROWS = ranks.BUCKET_ROWS, 50
    try:
        rows = ranks.ranked(df, "k", ranks.hash_unit(name), [F.md5(name.cast("binary")), name]).collect()
    finally:
        ranks.BUCKET_ROWS = kept
    import hashlib

    for k in {r.k for r in rows}:
        order = [r.name for r in sorted((r for r in rows if r.k == k), key=lambda r: r.place)]
        assert order == sorted(order, key=lambda n: hashlib.md5(n.encode()).hexdigest()) and {r.place for r in rows if r.k == k} == set(range(1, len(order) + 1))
    back = ranks.numbered(df.repartition(5), [F.col("k").desc(), name]).collect()
    want = sorted(((r.k, r.name) for r in back), key=lambda x: x[1])
    want = sorted(want, key=lambda x: x[0], reverse=True)
    assert [(r.k, r.name) for r in sorted(back, key=lambda r: r.place)] == want and {r.place for r in back} == set(range(1, 5001))


def plain_generation(pool, quota, texts, model, least):
    """The same by loops: rounds over papers; refusals before nearness, which goes by paper within a round."""
    cursor, have, accepted, skipped = dict.fromkeys(quota, 0), dict.fromkeys(quota, 0), [], 0
    words = lambda t: {w for w in __import__("re").findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in T.STOPWORDS}
    while True:
        went = False
        for p in sorted(quota):
            if have[p] < quota[p] and cursor[p] < len(pool[p]):
                went = True
                c = pool[p][cursor[p]]
                cursor[p] += 1
                r = calls.parse(model("PASSAGE:\n" + texts[c]))
                if not r or r.get("skip") or not r["entity"] or r["entity"].lower() not in r["question"].lower() or not calls.parse(model(f"QUESTION: {r['question']}\n\nPASSAGE:\n{texts[c]}"))["answers"]:
                    skipped += 1
                    continue
                a = words(r["question"])
                if any(len(a & b) >= least * len(a | b) for b in map(words, accepted) if a and b):
                    skipped += 1
                    continue
                accepted.append(r["question"])
                have[p] += 1
        if not went:
            return accepted, skipped


def test_generation(spark):
    from plumbline.plans.service import stub_writer

    r = __import__("random").Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts, pool = {}, {}
    for p in "xyz":
        for i in range(6):
            n = 4 if r.random() < 0.2 else 30
            texts[f"{p}::p0::c{i}"] = " ".join(r.choice(words[:12] if i % 2 else words) for _ in range(n))
        pool[p] = [f"{p}::p0::c{i}" for i in range(6)]
    quota = {"x": 3, "y": 2, "z": 6}
    chunks = spark.createDataFrame([(c, c[0], 0, int(c[-1]), t, "s") for c, t in texts.items()], "chunk_id string, arxiv_id string, page int, ordinal int, text string, text_sha8 string")
    pools = spark.createDataFrame([(p, c, i + 1) for p, cs in pool.items() for i, c in enumerate(cs)], "paper string, chunk_id string, place int")
    quotas = spark.createDataFrame(list(quota.items()), "paper string, quota long")
    made = generation.generate(pools, quotas, chunks, stub_writer, least=0.5, with_neighbours=False, sleep=lambda _: None)
    want, skipped = plain_generation(pool, quota, texts, stub_writer, 0.5)
    got = [q.question for q in made.questions.orderBy("qid").collect()]
    assert got == want and made.skipped.count() == skipped and not made.stopped and len(want) > 4

    def spent(prompt):
        if "QUESTION" in prompt:
            raise OSError("limit: requests per day")
        return stub_writer(prompt)

    made = generation.generate(pools, quotas, chunks, spent, sleep=lambda _: None)
    assert made.stopped and made.questions.isEmpty()


def test_refusals_in_order(spark):
    """Clusters of near questions, decided as one pass over them would."""
    r = __import__("random").Random(9)
    words = [f"word{i}" for i in range(14)]
    texts = [" ".join(r.sample(words, 4)) for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(texts)), "idx int, question string")
    sets, taken, want = [set(t.split()) for t in texts], [], {}
    for i, s in enumerate(sets):
        near = [j for j in taken if len(s & sets[j]) / len(s | sets[j]) >= 0.35]
        want[i] = near[0] if near else None
        if not near:
            taken.append(i)
    assert {x.idx: x.blocked_by for x in planning.accept(q).collect()} == want


def test_saved_tables_follow_their_inputs(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.read.text(str(tmp_path / "in"))

    (tmp_path / "in").write_text("a\n")
    get = lambda: saved.table(spark, "t", [str(tmp_path / "in")], make).count()
    assert get() == get() == 1 and len(made) == 1
    (tmp_path / "in").write_text("a\nb\n")
    assert get() == 2 and len(made) == 2
    saved.forget(spark)
    assert get() == 2 and len(made) == 3


def test_index_reads_only_the_buckets_asked_for(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([(f"c{i}", f"term{i} common") for i in range(200)], "chunk_id string, text string")).save(str(tmp_path))
    q = spark.createDataFrame([("q", "term7")], "qid string, text string")
    plan = bm25.search(index, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and len(list((tmp_path / "postings").glob("bucket=*"))) > 1
    assert [r.chunk_id for r in bm25.search(index, q, 3).collect()] == ["c7"]


def test_windows_of_a_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from plumbline.operators import chunking

    path = public.path("byte_bpe_50k.json")
    r = __import__("random").Random(1)
    texts = [" ".join("".join(r.choice("abcdefé日😀") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (0, 1, 30, 120, 400)] + ["<|endoftext|> is text here"]
    pages = spark.createDataFrame([(f"p{i}.pdf", 0, t) for i, t in enumerate(texts)] + [("none.pdf", 0, None)], files.PAGE)
    got = {(x.source, x.pos): x.page_content for x in chunking.split_by_offsets(pages, chunking.bpe_offsets(path), 40, 8).collect()}
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = {}
    for i, text in enumerate(texts):
        at = t.encode(text, add_special_tokens=False).offsets
        for pos, lo in enumerate(range(0, len(at), 32)):
            if pos and lo + 8 >= len(at):
                break
            want[f"p{i}.pdf", pos] = text[at[lo][0] : at[min(lo + 40, len(at)) - 1][1]]
    assert got == want and len(want) > 20


def test_report_lines_round_ties_as_their_sql(spark):
    names = [*evaluate.metrics.REPORTED, "mrr_mean_groups", "mrr_first", *[f"{m}_at_{k}" for m in ("recall", "sufficiency", "ndcg") for k in metrics.KS]]
    strata = spark.createDataFrame([("all", 32, *[0.03125] * len(set(names)))], ["stratum", "n", *dict.fromkeys(names)])
    lines = [r.line for r in report.strata_lines(strata).orderBy("place").collect()]
    assert lines[0] == "all n=32 MRR=0.0312" and lines[1] == "R@3=0.0312  R@5=0.0312  R@10=0.0312" and lines[-1] == "MRR_mean_groups=0.0312 MRR_first_group=0.0312"
    assert report.log_row(strata.withColumn("mrr", F.lit(0.0625)), "v", "n").first().line == "| v | 0.062 | 0.031 | 0.031 | n |"


def test_generation_reads_its_pool_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(c):
        read.add(1)
        return c

    chunks = spark.createDataFrame([(f"p{i % 2}::p0::c{i}", f"p{i % 2}", 0, i, f"passage {i} tells of thing{i}", "s") for i in range(12)], "chunk_id string, arxiv_id string, page int, ordinal int, text string, text_sha8 string")
    pool = chunks.select(F.col("arxiv_id").alias("paper"), seen("chunk_id").alias("chunk_id"), (F.col("ordinal") + 1).alias("place"))
    quotas = spark.createDataFrame([("p0", 3), ("p1", 3)], "paper string, quota long")

    def model(prompt):
        word = prompt.split("PASSAGE:\n")[1].split()[-1]
        return '{"answers": true}' if "QUESTION: " in prompt else f'{{"question": "{word} {word[5:]}abc?", "answer": "a", "entity": "{word}"}}'

    made = generation.generate(pool, quotas, chunks, model, with_neighbours=False, sleep=lambda _: None)
    assert made.questions.count() == 6 and read.value == 12


def test_search_keeps_its_hits(spark):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(c):
        ran.add(1)
        return c

    v = spark.createDataFrame([(f"c{i}", [float(i)]) for i in range(5)], "chunk_id string, embedding array<double>").withColumn("chunk_id", seen("chunk_id"))
    r = Retriever(None, v, spark.createDataFrame([(f"c{i}", "t") for i in range(5)], "chunk_id string, page_content string"))
    hits = r.search(spark.createDataFrame([("q", "t", [1.0])], "qid string, text string, embedding array<double>"), 3)
    after = ran.value
    assert hits.count() == 3 and [x.page_content for x in hits.collect()] == ["t"] * 3 and ran.value == after


def test_tokenizers_get_bounded_groups(spark, monkeypatch):
    from plumbline.operators import chunking

    monkeypatch.setattr(chunking, "GROUP_CHARS", 10)
    texts = ["", "abcdef", "ghij", "k", "x" * 30, "", "yz"]
    groups = list(chunking._groups(texts))
    assert sum(groups, []) == texts and all(len(g) == 1 or sum(map(len, g)) <= 10 for g in groups) and list(chunking._groups([])) == []
