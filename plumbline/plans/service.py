"""Queries of what a user of the library calls: search, chat, runs, reports, stores and files, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bm25, chat, chunking, corpus, evaluate, fusion, generation, golden, judging, metrics, report
from plumbline.operators.retriever import Retriever
from plumbline.plans import data, evaluation, intake, retrieval
from plumbline.sources import files, saved
from plumbline.sources.store import PROVIDERS, Store
from plumbline.streaming import ingest


def retriever(spark, sf_dir):
    shown = data.chunks(spark, sf_dir).withColumnRenamed("text", "page_content")
    return Retriever(data.index(spark, sf_dir), data.vectors(spark, sf_dir).select("chunk_id", "embedding"), shown)


def search_hybrid(spark, sf_dir):
    """The default mode and number of hits, with details and the text shown."""
    x = retriever(spark, sf_dir).search(data.asked(spark, sf_dir), details=True)
    return x.select("qid", "rank", "chunk_id", "rrf_score", "dense_rank", "sparse_rank", "l2_distance", "bm25_score", "found_by", "text_sha8")


SEARCH_HYBRID = f"""WITH {retrieval.fused_sql()} SELECT qid, rank, chunk_id, rrf_score, dense_rank, sparse_rank, l2_distance, bm25_score, {retrieval.FOUND_BY} AS found_by, substr(sha256(c.text), 1, 8) AS text_sha8
FROM fused LEFT JOIN chunks c USING (chunk_id) WHERE rank <= {fusion.SEARCH_K}"""


def search_dense(spark, sf_dir):
    x = retriever(spark, sf_dir).search(data.asked(spark, sf_dir), mode="Dense", details=True)
    return x.select("qid", "rank", "chunk_id", "l2_distance", "text_sha8")


SEARCH_DENSE = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, {data.ASKED}, {data.DENSE} SELECT qid, rank, chunk_id, l2_distance, substr(sha256(c.text), 1, 8) AS text_sha8
FROM near LEFT JOIN chunks c USING (chunk_id) WHERE rank <= {fusion.SEARCH_K}"""


def search_one(spark, sf_dir):
    """A single question: the first passage."""
    text = data.questions(spark, sf_dir).orderBy("item_id").first()["text"]
    return bm25.search_one(data.index(spark, sf_dir), spark, text, retrieval.TOP)


SEARCH_ONE = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, q AS (SELECT qid, text FROM questions ORDER BY item_id LIMIT 1), {data.bm25()}
SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT {retrieval.TOP}"""


def deterministic_search(spark, sf_dir):
    return spark.createDataFrame([(retriever(spark, sf_dir).deterministic(data.asked(spark, sf_dir)),)], "deterministic boolean")


def chat_answers(spark, sf_dir):
    """Three chunks a question from the hybrid retriever, and a stub model that counts its prompt's characters."""
    provider = next(iter(PROVIDERS))
    x = chat.respond(retriever(spark, sf_dir), data.asked(spark, sf_dir), provider, chat.models(provider)[0], lambda prompts: prompts.str.len().astype(str), include_context=True)
    return x.select("qid", F.col("answer").cast("long").alias("prompt_chars"), F.size("contexts").cast("long").alias("n_contexts"))


_frame = len(chat.PROMPT) - len("{context}{question}")
CHAT_ANSWERS = f"""WITH {retrieval.fused_sql()}, held AS (SELECT f.qid, count(*) AS n, sum(length(c.text)) AS chars FROM fused f JOIN chunks c USING (chunk_id) WHERE rank <= {fusion.CHAT_K} GROUP BY f.qid)
SELECT a.qid, CAST({_frame} + length(a.text) + coalesce(chars + 2 * (n - 1), 0) AS BIGINT) AS prompt_chars, coalesce(n, 0) AS n_contexts FROM asked a LEFT JOIN held USING (qid)"""


def golden_set(spark, sf_dir):
    """The questions that have gold, as a question set: pos and golden.QUESTIONS."""
    groups = data.gold(spark, sf_dir).groupBy("qid", "semantics", "group_idx").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))  # a question's gold
    whole = groups.groupBy("qid", "semantics").agg(F.array_sort(F.collect_list(F.struct("group_idx", F.struct("chunk_ids", F.lit(None).cast("string").alias("note")).alias("g")))).alias("gs"))
    text = data.asked(spark, sf_dir).select("qid", F.col("text").alias("question"))
    x = whole.join(text, "qid").select(
        "qid", "question", "semantics", F.transform("gs", lambda g: g["g"]).alias("gold_groups"), F.lit("").alias("expected_answer"), F.array().cast("array<string>").alias("source_papers"),
        F.lit("passage").alias("provenance"), F.array(F.lit("test")).alias("tags"), F.create_map().cast("map<string,string>").alias("chunk_text_sha8"),
    )
    return x.withColumn("pos", F.conv(F.substring("qid", 2, 9), 10, 10).cast("int") * 2 + (F.col("semantics") == "all_required").cast("int"))


def golden_round_trip(spark, sf_dir):
    """The set written as one JSON document, read, and taken apart again."""
    path = saved.folder(spark, "golden")
    fields = F.struct(*[c.split()[0] for c in golden.QUESTIONS.split(", ") if " " in c])
    qs = golden_set(spark, sf_dir).agg(F.collect_list(fields).alias("questions"))  # a question set fits one document
    golden.write(qs.select(F.lit("v1").alias("version"), F.lit("sha256:x").alias("corpus_fingerprint"), F.create_map(F.lit("chunk_size"), F.lit(chunking.SIZE)).alias("chunking"), "questions"), path)
    return golden.gold(golden.questions(golden.read(spark, path)))


GOLDEN_ROUND_TRIP = f"WITH {data.CHUNKS}, {data.QUESTIONS}, {data.ASKED}, {data.GOLD} SELECT qid, semantics, group_idx, chunk_id FROM gold JOIN (SELECT DISTINCT qid FROM asked) USING (qid)"


def selected_questions(spark, sf_dir):
    """The first twenty questions of the set."""
    return golden.select(golden_set(spark, sf_dir), first=20).select("pos", "qid")


SELECTED = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, {data.ASKED}, {data.GOLD}
SELECT CAST(CAST(substr(qid, 2) AS INT) * 2 + CAST(semantics = 'all_required' AS INT) AS INT) AS pos, qid FROM (SELECT DISTINCT qid, semantics FROM gold JOIN asked USING (qid)) ORDER BY pos LIMIT 20"""


def _evaluated(spark, sf_dir):
    q = data.asked(spark, sf_dir).select("qid", "embedding")
    return evaluate.evaluate(retriever(spark, sf_dir), golden_set(spark, sf_dir), q, version="v1")


def evaluate_run(spark, sf_dir):
    """A whole run: the set is validated, asked, scored, and each question's hits are kept."""
    run = _evaluated(spark, sf_dir)
    x = run.scores.join(run.details, "qid")
    return x.select(
        "qid", "semantics", F.round("rr", 9).alias("rr"), F.round("ndcg_at_10", 9).alias("ndcg_at_10"), F.array_join("top10", ",").alias("top10"), F.array_join("top10_found_by", ",").alias("top10_found_by"), F.size(F.filter("top10_distances", lambda d: d.isNull())).alias("without_distance"),
        "near_ties_in_topk", F.array_join("gold_chunk_ids", ",").alias("gold_chunk_ids"), F.coalesce(F.array_join(F.transform("gold_hits", lambda h: F.concat_ws(" ", h["chunk_id"], h["rank"], h["found_by"])), ","), F.lit("")).alias("gold_hits"),
    )


EVALUATE_RUN = f"""{evaluation.BASE}, f AS (SELECT *, {retrieval.FOUND_BY} AS found_by, l2_distance - lag(l2_distance) OVER (PARTITION BY qid ORDER BY rank) AS gap FROM fused WHERE rank <= 50),
top AS (SELECT qid, string_agg(chunk_id, ',' ORDER BY rank) AS top10, string_agg(found_by, ',' ORDER BY rank) AS top10_found_by, count(*) FILTER (WHERE l2_distance IS NULL) AS without_distance, count(*) FILTER (WHERE abs(gap) < 1e-6) AS near_ties_in_topk FROM f WHERE rank <= 10 GROUP BY qid),
wanted AS (SELECT qid, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS gold_chunk_ids FROM gold GROUP BY qid),
reached AS (SELECT qid, string_agg(chunk_id || ' ' || rank || ' ' || found_by, ',' ORDER BY chunk_id) AS gold_hits FROM f JOIN (SELECT DISTINCT qid, chunk_id FROM gold) g USING (qid, chunk_id) GROUP BY qid)
SELECT h.qid, h.semantics, round(rr, 9) AS rr, round(ndcg_at_10, 9) AS ndcg_at_10, top10, top10_found_by, CAST(without_distance AS INT) AS without_distance, near_ties_in_topk, gold_chunk_ids, coalesce(gold_hits, '') AS gold_hits
FROM hybrid h JOIN top USING (qid) JOIN wanted USING (qid) LEFT JOIN reached USING (qid)"""


def run_round_trip(spark, sf_dir):
    """A run saved with its artifacts and read back as a comparison does."""
    path = saved.folder(spark, "run")
    _evaluated(spark, sf_dir).save(path)
    meta = files.read_meta(spark, path)
    x = files.read_run(spark, path)
    return x.select("qid", "semantics", F.round("rr", 9).alias("rr"), F.size("coverage_ranks").cast("long").alias("n_groups"), F.size(F.filter("coverage_ranks", lambda c: c.isNotNull())).cast("long").alias("n_covered"), F.lit(meta["n_questions"]).cast("long").alias("n_questions"))


RUN_ROUND_TRIP = f"""{evaluation.BASE}, c AS (SELECT qid, count(c) AS n_covered FROM cov_hybrid GROUP BY qid)
SELECT qid, semantics, round(rr, 9) AS rr, n_groups, n_covered, (SELECT count(*) FROM hybrid) AS n_questions FROM hybrid JOIN c USING (qid)"""


def report_lines(spark, sf_dir):
    return report.strata_lines(metrics.by_stratum(evaluation.run(spark, sf_dir, "hybrid")))


_at = lambda label, name: " || '  ' || ".join(f"printf('{label}@{k}=%.4f', {name}_at_{k})" for k in metrics.KS)
REPORT = f"""WITH s AS (SELECT *, list_position(['all', 'any_of', 'all_required'], stratum) * 10 AS o FROM (
  {evaluation.STRATUM_SCORES.replace('round(', '(').replace(', 9)', ')')}))
SELECT CAST(o AS INT) AS place, printf('%s n=%d MRR=%.4f', stratum, n, mrr) AS line FROM s
UNION ALL SELECT CAST(o + 1 AS INT), {_at('R', 'recall')} FROM s
UNION ALL SELECT CAST(o + 2 AS INT), {_at('Suff', 'sufficiency')} FROM s
UNION ALL SELECT CAST(o + 3 AS INT), {_at('nDCG', 'ndcg')} FROM s
UNION ALL SELECT 99, printf('MRR_mean_groups=%.4f MRR_first_group=%.4f', mrr_mean_groups, mrr_first) FROM s WHERE stratum = 'all'"""


def log_row(spark, sf_dir):
    return report.log_row(metrics.by_stratum(evaluation.run(spark, sf_dir, "hybrid")), "hybrid_rrf60", "whole set")


LOG_ROW = f"SELECT printf('| hybrid_rrf60 | %.3f | %.3f | %.3f | whole set |', mrr, recall_at_5, ndcg_at_10) AS line FROM ({evaluation.STRATUM_SCORES}) WHERE stratum = 'all'"


def keep_union(spark, sf_dir):
    """Papers of good quality, and anchors."""
    good = data.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    return corpus.keep_set(good, intake._candidates(spark, sf_dir).where("source = 'anchor'"))


KEEP_UNION = "SELECT CAST(doc_id AS VARCHAR) AS arxiv_id FROM labels WHERE quality = 1 UNION SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 0"


def reference_ids(spark, sf_dir):
    """Distinct references in order, from what a service tells of each paper; some have no id."""
    i = F.col("doc_id")
    item = lambda kind, n: F.struct(F.create_map(F.lit(kind), n.cast("string")).alias("externalIds"))
    items = F.when(i % 11 != 0, F.array(item("ArXiv", i * 7 % 1500), item("DOI", i), item("ArXiv", i * 13 % 900), item("ArXiv", i * 7 % 1500)))
    return data.table(spark, sf_dir, "documents").select("doc_id", F.array_join(corpus.references(items), ",").alias("refs"))


REFERENCES = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([CAST(doc_id * 7 % 1500 AS VARCHAR), CAST(doc_id * 13 % 900 AS VARCHAR)])), ',') END AS refs FROM documents"


def chat_history(spark, sf_dir):
    """One more question for every conversation, the last turn of the even ones undone, every fifth one cleared."""
    turns = chat.turns(data.table(spark, sf_dir, "conversations"))
    convs = turns.select("conv_id").distinct()
    more = convs.select("conv_id", F.lit("and then?").alias("question"), F.lit("that is all").alias("answer"), F.lit(0).alias("at"))
    x = chat.append(turns, more)
    even = F.col("conv_id") % 2 == 0
    x = chat.undo(x.where(even)).select(*x.columns).unionByName(x.where(~even))
    return chat.clear(x, convs.where("conv_id % 5 = 0")).select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question_md5"))


CHAT_HISTORY = """WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(text) AS question_md5 FROM t WHERE conv_id % 5 <> 0
UNION ALL SELECT conv_id, max(turn) + 1, md5('and then?') FROM t WHERE conv_id % 5 <> 0 AND conv_id % 2 <> 0 GROUP BY conv_id"""


def chat_export(spark, sf_dir):
    """The history as CSV, read back."""
    turns = chat.turns(data.table(spark, sf_dir, "conversations"))
    path = saved.folder(spark, "chat")
    stamped = turns.select("question", "answer", F.lit("groq").alias("provider"), F.lit("m").alias("model"), F.array(F.lit("a.pdf"), F.lit("b.pdf")).alias("pdf_names"), F.timestamp_seconds(F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("ts"))
    files.write_chat(stamped, path)
    x = spark.read.csv(path, header=True, escape="\\", multiLine=True)
    return x.select("ts", "pdf_names", F.md5(F.col("question").cast("binary")).alias("question_md5"))


CHAT_EXPORT = "SELECT strftime(make_timestamp((conv_id * 1000 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, 'a.pdf, b.pdf' AS pdf_names, md5(text) AS question_md5 FROM conversations WHERE role = 'user'"


def allowed_models(spark, sf_dir):
    """The providers' models, and whether a chat with each is ready: with chunks of its collection alone."""
    n = F.when(F.col("provider") == "groq", data.chunks(spark, sf_dir).count()).otherwise(0)
    return chat.model_table(spark).select("provider", "model", chat.ready(F.col("provider"), F.col("model"), n).alias("ready"))


ALLOWED = "SELECT p AS provider, unnest(m) AS model, p = 'groq' AS ready FROM (VALUES " + ", ".join(f"('{p}', {m!r})" for p, m in PROVIDERS.items()) + ") x(p, m)"


def parsed_replies(spark, sf_dir):
    """Verdicts out of replies in several shapes: parts of a message, a string, bare text, and no JSON at all."""
    x = data.table(spark, sf_dir, "labels").select("doc_id", (1 + F.col("quality")).alias("g"))
    bare = F.format_string('Well: {"groundedness": %d, "answer_correctness": 2}. Done', "g")
    listed = F.format_string('[{"text": "Well: {\\"groundedness\\": %d, "}, "\\"answer_correctness\\": 2}"]', "g")
    quoted = F.format_string('"{\\"groundedness\\": %d, \\"answer_correctness\\": 2}"', "g")
    reply = F.when(F.col("doc_id") % 4 == 0, bare).when(F.col("doc_id") % 4 == 1, listed).when(F.col("doc_id") % 4 == 2, quoted).otherwise("no { idea")
    return x.select("doc_id", judging.parse_verdict(reply)["groundedness"].alias("groundedness"), T.is_daily_quota(F.concat(F.lit("Limit: TOKENS per Day "), reply)).alias("daily"), T.is_daily_quota(reply).alias("plain"))


REPLIES = "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN CAST(1 + quality AS INT) END AS groundedness, true AS daily, false AS plain FROM labels"


def query_strings(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("search_query").alias("name"), F.concat(F.lit("cat:"), "source").alias("value")), F.struct(F.lit("start").alias("name"), F.col("doc_id").cast("string").alias("value")))
    return data.table(spark, sf_dir, "documents").select("doc_id", T.query_string(pairs).alias("query"))


QUERY_STRINGS = "SELECT doc_id, 'search_query=cat%3A' || source || '&start=' || doc_id AS query FROM documents"


def paged_candidates(spark, sf_dir):
    """A service of 1,000 entries in pages of 50, of which some repeat and some are too old."""

    def fetch(start: int, size: int) -> list[dict]:
        return [{"arxiv_id": f"p{i % 700}", "published": "soon" if i % 9 == 0 else f"20{10 + i % 15:02}-01-01T00:00:00Z"} for i in range(start, min(start + size, 1000))]

    return files.paged(spark, fetch, 2000, cutoff="2016-01-01").select("pos", "arxiv_id", "published")


PAGED = """WITH e AS (SELECT i AS pos, 'p' || (i % 700) AS arxiv_id, CASE WHEN i % 9 = 0 THEN 'soon' ELSE '20' || (10 + i % 15) || '-01-01T00:00:00Z' END AS published FROM generate_series(0, 999) t(i))
SELECT min(pos) AS pos, arxiv_id, arg_min(published, pos) AS published FROM e GROUP BY arxiv_id HAVING arg_min(published, pos) = 'soon' OR arg_min(published, pos) >= '2016-01-01'"""


def fetched_manifest(spark, sf_dir):
    """Half the papers are at hand, the others fetched; every seventh fetch fails."""
    d = data.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("arxiv_id"), "doc_id")

    def get(i: str) -> bytes:
        if int(i) % 7 == 0:
            raise OSError("timeout")
        return i.encode() * 3

    there = d.where("doc_id % 2 = 0").select(F.concat("arxiv_id", F.lit(".pdf")).alias("path"), F.col("arxiv_id").cast("binary").alias("content"))
    return corpus.manifest(d.select("arxiv_id"), corpus.fetch(d, there, get))


FETCHED = """SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, CASE WHEN ok THEN 'ok' ELSE 'download_failed' END AS status, CASE WHEN ok THEN sha256(body) END AS sha256, CASE WHEN ok THEN strlen(body) END AS file_size_bytes, CASE WHEN NOT ok THEN 'timeout' END AS error
FROM (SELECT doc_id, doc_id % 2 = 0 OR doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE repeat(CAST(doc_id AS VARCHAR), 3) END AS body FROM documents)"""


def _store_rows(c, provider, prefix=""):
    text = F.concat(F.lit(prefix), "text")
    return c.select("chunk_id", "arxiv_id", "page", "ordinal", text.alias("page_content"), T.sha8(text).alias("text_sha8"), F.array().cast("array<float>").alias("embedding"), F.create_map(F.lit("source"), F.col("arxiv_id")).alias("metadata"), F.lit(provider).alias("provider"))


def store_round_trip(spark, sf_dir):
    """A collection built in three writes, the last over what is there, beside another provider's; what is missing then."""
    c = data.chunks(spark, sf_dir)
    s = Store(spark, saved.folder(spark, "store"))
    s.create()
    even = F.col("arxiv_id").cast("long") % 2 == 0
    s.upsert(_store_rows(c.where(even), "groq"))
    s.upsert(_store_rows(c.where("ordinal = 0"), "gemini"))
    s.upsert(_store_rows(c.where("ordinal = 1"), "groq", "new "))
    gone = s.missing(_store_rows(c, "groq")).select("chunk_id", F.lit("missing").alias("provider"), F.lit("").alias("text_sha8"))
    return s.read().select("chunk_id", "provider", "text_sha8").unionByName(gone)


STORE_ROUND_TRIP = f"""WITH {data.CHUNKS}, c AS (SELECT *, CAST(arxiv_id AS BIGINT) % 2 = 0 AS even FROM chunks)
SELECT chunk_id, 'groq' AS provider, substr(sha256(CASE WHEN ordinal = 1 THEN 'new ' || text ELSE text END), 1, 8) AS text_sha8 FROM c WHERE even OR ordinal = 1
UNION ALL SELECT chunk_id, 'gemini', substr(sha256(text), 1, 8) FROM c WHERE ordinal = 0
UNION ALL SELECT chunk_id, 'missing', '' FROM c WHERE NOT even AND ordinal <> 1"""


def stream_ingest(spark, sf_dir):
    """Pages that land as files, in two lots with one page twice, streamed into a store; then searched by its index."""
    base = saved.folder(spark, "stream")
    s = Store(spark, f"{base}/store")
    p = data.pages(spark, sf_dir)
    go = lambda: ingest.watch(spark, f"{base}/landing", s, "groq", f"{base}/checkpoint").awaitTermination()
    odd = F.substring_index(F.substring_index("source", "/", -1), ".", 1).cast("long") % 2 == 1
    p.where(odd).write.json(f"{base}/landing")
    go()
    p.where(~odd).unionByName(p.where("source = 'corpus/1.pdf'")).write.mode("append").json(f"{base}/landing")
    go()
    return s.read("groq").select("chunk_id", "text_sha8")


STREAM_INGEST = f"WITH {data.CHUNKS} SELECT chunk_id, substr(sha256(text), 1, 8) AS text_sha8 FROM chunks"


def store_index(spark, sf_dir):
    """The index that a store's retriever keeps for its snapshot."""
    s = Store(spark, saved.folder(spark, "store"))
    s.upsert(_store_rows(data.chunks(spark, sf_dir), "groq"))
    return bm25.index_stats(Retriever.of(s, "groq").index)


def unique_chunks(spark, sf_dir):
    return chunking.guard_unique(data.chunks(spark, sf_dir)).agg(F.count("*").alias("n"))


UNIQUE = f"WITH {data.CHUNKS} SELECT count(DISTINCT chunk_id) AS n FROM chunks"


def chunk_documents_bpe(spark, sf_dir):
    """Windows of 500 tokens of a public vocabulary, 50 of them shared, as a model would read them."""
    import public_tokenizers

    pages = data.pages(spark, sf_dir)
    c = chunking.assign_ids(chunking.split_by_offsets(pages, chunking.bpe_offsets(public_tokenizers.path("byte_bpe_50k.json"))))
    return c.select("chunk_id", "page", "ordinal", F.char_length("page_content").cast("long").alias("n_chars"), "text_sha8")


def stub_writer(prompt: str) -> str:
    """Asks about a passage's first words; answers yes if the passage holds the question's name."""
    passage = prompt.split("PASSAGE:\n", 1)[1]
    words = passage.split()
    if "QUESTION: " in prompt:
        question = prompt.split("QUESTION: ", 1)[1].split("\n\nPASSAGE:", 1)[0]
        return f'{{"answers": {str(question.split(" of ")[-1].rstrip("?") in passage).lower()}}}'
    if len(words) < 12:
        return '{"skip": true, "reason": "short"}'
    name = " ".join(w for w in words[4:9] if w.isalnum())
    return pd.Series({"question": f"What is told of {name}?", "answer": words[0], "entity": name}).to_json()


def generated_questions(spark, sf_dir):
    """A set written by a stub, from pools by source with their quotas, passing over second chunks."""
    c = data.chunks(spark, sf_dir)
    pool = intake.question_pools(spark, sf_dir)
    made = generation.generate(pool, intake.question_quotas(spark, sf_dir), c, stub_writer, used=c.where("ordinal = 1").select("chunk_id"), sleep=lambda _: None)
    return made.questions.select("qid", "question", F.size(F.col("gold_groups")[0]["chunk_ids"]).cast("long").alias("n_gold"), F.col("source_papers")[0].alias("paper"), "jaccard", "flagged")


QUERIES = {
    "search_hybrid": (search_hybrid, SEARCH_HYBRID),
    "search_dense": (search_dense, SEARCH_DENSE),
    "search_one": (search_one, SEARCH_ONE),
    "deterministic_search": (deterministic_search, "SELECT true AS deterministic"),
    "chat_answers": (chat_answers, CHAT_ANSWERS),
    "golden_round_trip": (golden_round_trip, GOLDEN_ROUND_TRIP),
    "selected_questions": (selected_questions, SELECTED),
    "evaluate_run": (evaluate_run, EVALUATE_RUN),
    "run_round_trip": (run_round_trip, RUN_ROUND_TRIP),
    "report_lines": (report_lines, REPORT),
    "log_row": (log_row, LOG_ROW),
    "keep_union": (keep_union, KEEP_UNION),
    "reference_ids": (reference_ids, REFERENCES),
    "chat_history": (chat_history, CHAT_HISTORY),
    "chat_export": (chat_export, CHAT_EXPORT),
    "allowed_models": (allowed_models, ALLOWED),
    "parsed_replies": (parsed_replies, REPLIES),
    "query_strings": (query_strings, QUERY_STRINGS),
    "paged_candidates": (paged_candidates, PAGED),
    "fetched_manifest": (fetched_manifest, FETCHED),
    "store_round_trip": (store_round_trip, STORE_ROUND_TRIP),
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "store_index": (store_index, retrieval.BM25_STATS),
    "unique_chunks": (unique_chunks, UNIQUE),
    "chunk_documents_bpe": (chunk_documents_bpe, None),
    "generated_questions": (generated_questions, None),
}
