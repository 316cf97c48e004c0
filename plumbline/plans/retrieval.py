"""Queries of chunking, indexing, retrieval and fusion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bm25, chunking, dense, fusion
from plumbline.plans import data

TOP = 10


def bm25_top10(spark, sf_dir):
    return bm25.search(data.index(spark, sf_dir), data.questions(spark, sf_dir).select("qid", "text"), TOP)


def bm25_okapi_top10(spark, sf_dir):
    return bm25.search(data.index(spark, sf_dir, "okapi"), data.questions(spark, sf_dir).select("qid", "text"), TOP)


def _ranked(variant="lucene", k1=1.2):
    return f"""WITH {data.CHUNKS}, {data.QUESTIONS}, q AS (SELECT qid, text FROM questions), {data.bm25(k1, variant)}
SELECT qid, rank, chunk_id, score FROM (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM scored)
WHERE rank <= {TOP}"""


def bm25_variant_overlap(spark, sf_dir):
    mark = lambda hits, i: hits.select("qid", "chunk_id", F.lit(i).alias("arm"))
    both = mark(bm25_top10(spark, sf_dir), 1).unionByName(mark(bm25_okapi_top10(spark, sf_dir), 2)).groupBy("qid", "chunk_id").agg(F.sum("arm").alias("arms"))
    each = both.groupBy("qid").agg(F.count_if(F.col("arms") == 3).alias("shared"), F.count_if(F.col("arms") != 2).alias("n")).where("n > 0")
    return each.agg(F.count("*").alias("n_questions"), F.round(F.avg("shared"), 6).alias("mean_shared"))


BM25_OVERLAP = f"""WITH a AS ({_ranked()}), b AS ({_ranked('okapi', 1.5)})
SELECT count(*) AS n_questions, round(avg(coalesce(shared, 0)), 6) AS mean_shared
FROM (SELECT DISTINCT qid FROM a) x LEFT JOIN (SELECT a.qid, count(*) AS shared FROM a JOIN b USING (qid, chunk_id) GROUP BY ALL) y USING (qid)"""


def bm25_explain(spark, sf_dir):
    index, q = data.index(spark, sf_dir), data.questions(spark, sf_dir).select("qid", "text")
    first = bm25.search(index, q, 1).select("qid", "chunk_id")
    return bm25.explain(index, q, first).select("qid", "chunk_id", "term", F.round("value", 6).alias("value"))


BM25_EXPLAIN = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, q AS (SELECT qid, text FROM questions), {data.bm25()},
best AS (SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM scored) WHERE r = 1)
SELECT qid, chunk_id, term, round(value, 6) AS value FROM value JOIN best USING (qid, chunk_id) WHERE value <> 0"""


def bm25_index_stats(spark, sf_dir):
    return bm25.index_stats(data.index(spark, sf_dir)).select("n_docs", "avgdl", "vocabulary", "k1", "b", "idf_variant", "tokenization_version")


BM25_STATS = f"""WITH {data.CHUNKS}, {data.QUESTIONS}, q AS (SELECT qid, text FROM questions), {data.bm25()}
SELECT n_docs, round(avgdl, 3) AS avgdl, (SELECT count(*) FROM terms) AS vocabulary, CAST(1.2 AS DOUBLE) AS k1, CAST(0.75 AS DOUBLE) AS b, 'lucene' AS idf_variant, 'v1' AS tokenization_version FROM stats"""


def _term_stats(variant):
    def query(spark, sf_dir):
        return data.index(spark, sf_dir, variant).terms.select("term", "df", F.round("idf", 9).alias("idf"))

    sql = f"WITH {data.CHUNKS}, {data.QUESTIONS}, q AS (SELECT qid, text FROM questions), {data.bm25(1.2, variant)} SELECT term, df, round(idf, 9) AS idf FROM terms"
    return query, sql


def bm25_postings(spark, sf_dir):
    return data.index(spark, sf_dir).postings.select("term", "chunk_id", "tf")


POSTINGS = f"WITH {data.CHUNKS}, {data.terms('chunks', 'chunk_id', 'occ')} SELECT term, chunk_id, count(*) AS tf FROM occ GROUP BY ALL"


def bm25_documents(spark, sf_dir):
    return data.index(spark, sf_dir).docs.select("chunk_id", "dl")


DOCUMENTS = f"WITH {data.CHUNKS}, {data.terms('chunks', 'chunk_id', 'occ')} SELECT c.chunk_id, coalesce(dl, 0) AS dl FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS dl FROM occ GROUP BY ALL) USING (chunk_id)"


def tokenize_documents(spark, sf_dir):
    d = data.documents(spark, sf_dir).withColumn("t", T.tokenize(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


TOKENIZE = rf"""WITH t AS (SELECT doc_id, flatten(list_transform(
    regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+(?:[._\-/][a-z0-9]+)*'),
    lambda t: CASE WHEN regexp_matches(t, '[._\-/]') THEN list_concat([t], string_split_regex(t, '[._\-/]')) ELSE [t] END)) AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""


def chunk_documents(spark, sf_dir):
    c = chunking.chunk(data.pages(spark, sf_dir))
    return c.select("chunk_id", "arxiv_id", "page", "ordinal", F.char_length("page_content").cast("long").alias("n_chars"), "text_sha8")


CHUNK_DOCUMENTS = f"WITH {data.CHUNKS} SELECT chunk_id, arxiv_id, page, ordinal, length(text) AS n_chars, substr(sha256(text), 1, 8) AS text_sha8 FROM chunks"


def chunk_counts(spark, sf_dir):
    return chunking.paper_counts(data.chunks(spark, sf_dir))


CHUNK_COUNTS = f"WITH {data.CHUNKS} SELECT arxiv_id, count(*) AS n_chunks FROM chunks GROUP BY ALL"


def chunk_count_summary(spark, sf_dir):
    x = chunking.count_summary(data.chunks(spark, sf_dir))
    return x.withColumn("mean_chunks", F.round("mean_chunks", 9))


CHUNK_SUMMARY = f"SELECT count(*) AS n_papers, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, round(avg(n_chunks), 9) AS mean_chunks, min(n_chunks) AS min_chunks, max(n_chunks) AS max_chunks FROM ({CHUNK_COUNTS})"


def chunk_neighbours(spark, sf_dir):
    return chunking.neighbours(data.chunks(spark, sf_dir))


NEIGHBOURS = f"WITH {data.CHUNKS} SELECT a.chunk_id, b.chunk_id AS neighbour_id FROM chunks a JOIN chunks b ON a.arxiv_id = b.arxiv_id AND a.page = b.page AND abs(a.ordinal - b.ordinal) = 1"


def chunk_browse(spark, sf_dir):
    return chunking.browse(data.chunks(spark, sf_dir).withColumnRenamed("text", "page_content"))


BROWSE = rf"""WITH {data.CHUNKS}, f AS (SELECT chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks)
SELECT chunk_id, CASE WHEN length(t) > 320 THEN substr(t, 1, 320) || '...' ELSE t END AS preview FROM f"""


def chunk_ids_round_trip(spark, sf_dir):
    c = data.chunks(spark, sf_dir).withColumn("at", T.parse_chunk_id(F.col("chunk_id")))
    return c.select("chunk_id", "at.arxiv_id", "at.page", "at.ordinal", T.join_key(F.lit(""), F.col("text")).alias("text_key"))


ROUND_TRIP = f"""WITH {data.CHUNKS} SELECT chunk_id, regexp_extract(chunk_id, '^([^:]+)::p(\\d+)::c(\\d+)$', 1) AS arxiv_id,
CAST(regexp_extract(chunk_id, '^([^:]+)::p(\\d+)::c(\\d+)$', 2) AS INT) AS page, CAST(regexp_extract(chunk_id, '^([^:]+)::p(\\d+)::c(\\d+)$', 3) AS INT) AS ordinal,
'text:' || substr(sha256(text), 1, 8) AS text_key FROM chunks"""


def dense_top10(spark, sf_dir):
    return dense.search(data.vectors(spark, sf_dir), data.asked(spark, sf_dir), TOP)


DENSE = f"WITH {data.QUESTIONS}, {data.ASKED}, {data.DENSE} SELECT qid, rank, chunk_id, l2_distance FROM near WHERE rank <= {TOP}"


def dense_near_ties(spark, sf_dir):
    return dense.near_ties(dense_top10(spark, sf_dir), TOP, 0.005)


NEAR_TIES = f"""WITH {data.QUESTIONS}, {data.ASKED}, {data.DENSE},
g AS (SELECT qid, l2_distance - lag(l2_distance) OVER (PARTITION BY qid ORDER BY rank) AS gap FROM near WHERE rank <= {TOP})
SELECT qid, count(*) FILTER (WHERE abs(gap) < 0.005) AS near_ties FROM g GROUP BY qid"""


def hybrid_top10(spark, sf_dir):
    return fusion.hybrid(data.index(spark, sf_dir), data.vectors(spark, sf_dir), data.asked(spark, sf_dir), TOP)


def fused_sql(k=60, wd=1.0, wb=1.0, depth=50):
    """CTEs up to fused(qid, rank, chunk_id, ...)."""
    return f"""{data.CHUNKS}, {data.QUESTIONS}, {data.ASKED}, q AS (SELECT qid, text FROM asked), {data.bm25()}, {data.DENSE},
sparse AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM scored),
joined AS (
  SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, d.l2_distance, s.score AS bm25_score,
         round(coalesce({wd} / ({k} + d.rank), 0) + coalesce({wb} / ({k} + s.rank), 0), 12) AS rrf_score
  FROM (SELECT * FROM near WHERE rank <= {depth}) d FULL JOIN (SELECT * FROM sparse WHERE rank <= {depth}) s ON d.qid = s.qid AND d.chunk_id = s.chunk_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, chunk_id) AS INT) AS rank FROM joined)"""


FOUND_BY = "CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'bm25' END"
HYBRID = f"WITH {fused_sql()} SELECT qid, rank, chunk_id, rrf_score, dense_rank, sparse_rank, l2_distance, bm25_score, {FOUND_BY} AS found_by FROM fused WHERE rank <= {TOP}"


def ranked_arms(spark, sf_dir, depth=fusion.POOL):
    q = data.asked(spark, sf_dir)
    return fusion.arms(dense.search(data.vectors(spark, sf_dir), q, depth), bm25.search(data.index(spark, sf_dir), q, depth))


def rrf_fuse(spark, sf_dir):
    x = fusion.rrf(ranked_arms(spark, sf_dir), weights={"bm25": 2.0})
    return x.where("rank <= 10").select("qid", "rank", "chunk_id", "rrf_score", F.col("ranks")["dense"].alias("dense_rank"), F.col("ranks")["bm25"].alias("sparse_rank"))


RRF = f"WITH {fused_sql(60, 1.0, 2.0)} SELECT qid, rank, chunk_id, rrf_score, dense_rank, sparse_rank FROM fused WHERE rank <= 10"

_terms, _terms_sql = _term_stats("lucene")
_okapi, _okapi_sql = _term_stats("okapi")

QUERIES = {
    "bm25_top10": (bm25_top10, _ranked()),
    "bm25_okapi_top10": (bm25_okapi_top10, _ranked("okapi", 1.5)),
    "bm25_variant_overlap": (bm25_variant_overlap, BM25_OVERLAP),
    "bm25_explain": (bm25_explain, BM25_EXPLAIN),
    "bm25_index_stats": (bm25_index_stats, BM25_STATS),
    "bm25_terms_lucene": (_terms, _terms_sql),
    "bm25_terms_okapi": (_okapi, _okapi_sql),
    "bm25_postings": (bm25_postings, POSTINGS),
    "bm25_documents": (bm25_documents, DOCUMENTS),
    "tokenize_documents": (tokenize_documents, TOKENIZE),
    "chunk_documents": (chunk_documents, CHUNK_DOCUMENTS),
    "chunk_counts": (chunk_counts, CHUNK_COUNTS),
    "chunk_count_summary": (chunk_count_summary, CHUNK_SUMMARY),
    "chunk_neighbours": (chunk_neighbours, NEIGHBOURS),
    "chunk_browse": (chunk_browse, BROWSE),
    "chunk_ids_round_trip": (chunk_ids_round_trip, ROUND_TRIP),
    "dense_top10": (dense_top10, DENSE),
    "dense_near_ties": (dense_near_ties, NEAR_TIES),
    "hybrid_top10": (hybrid_top10, HYBRID),
    "rrf_fuse": (rrf_fuse, RRF),
}
