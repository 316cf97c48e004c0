"""Queries of question planning, corpus intake, the store and chat history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chat, corpus, planning
from plumbline.plans import data
from plumbline.sources import store

TOTAL = 60


def _screened(spark, sf_dir):
    return planning.screen(data.chunks(spark, sf_dir).withColumn("paper", F.col("arxiv_id")))


def screened_chunks(spark, sf_dir):
    return _screened(spark, sf_dir).select("chunk_id", "usable", "reason")


SCREENED = rf"""WITH {data.CHUNKS},
n AS (SELECT chunk_id, arxiv_id AS paper, length(text) AS n, len(regexp_extract_all(text, '(?i)In Proceedings|Proceedings of|Conference on|Transactions on|Journal of|preprint|arXiv preprint|pages \d+')) AS venues,
  len(regexp_extract_all(text, '\b(?:19|20)\d{{2}}[a-z]?\b')) AS years, len(regexp_extract_all(text, 'arXiv:\d{{4}}\.\d{{4,5}}')) AS arxiv, len(regexp_extract_all(text, '\[\d+\]')) AS brackets,
  len(regexp_extract_all(text, '[a-z]{{3,}}\.\s+[A-Z]')) AS sentences, len(regexp_extract_all(text, '\p{{L}}')) / greatest(length(text), 1) AS alpha, len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) AS digits FROM chunks),
screened AS (SELECT chunk_id, paper, CASE WHEN n < 700 THEN format('too short ({{}} chars)', n) WHEN venues >= 3 THEN format('bibliography ({{}} venue phrases)', venues)
  WHEN years >= 5 AND venues >= 1 THEN format('bibliography ({{}} years, {{}} venue phrases)', years, venues) WHEN arxiv >= 2 AND years >= 4 THEN format('bibliography ({{}} arXiv ids, {{}} years)', arxiv, years)
  WHEN brackets >= 4 AND venues >= 1 THEN format('bibliography ({{}} bracketed refs)', brackets) WHEN alpha < 0.68 THEN printf('table/numeric (alpha_ratio %.2f)', alpha)
  WHEN digits > 0.07 AND sentences <= 3 THEN printf('table (digit_ratio %.2f, %d sentences)', digits, sentences) WHEN sentences <= 1 THEN 'no sentence structure' ELSE 'ok' END AS reason FROM n)"""
SCREENED_CHUNKS = f"{SCREENED} SELECT chunk_id, reason = 'ok' AS usable, reason FROM screened"


def screen_rejections(spark, sf_dir):
    return planning.rejections(_screened(spark, sf_dir))


REJECTIONS = f"{SCREENED} SELECT string_split(reason, ' (')[1] AS reason, count(*) AS n FROM screened WHERE reason <> 'ok' GROUP BY 1"


def _counts(spark, sf_dir):
    return data.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("paper")).agg(F.count("*").alias("n"))


def question_quotas(spark, sf_dir):
    return planning.allocate(_counts(spark, sf_dir), TOTAL)


QUOTAS = f"""WITH c AS (SELECT source AS paper, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT paper, ({TOTAL} - count(*) OVER ()) * n / sum(n) OVER () AS exact FROM c),
r AS (SELECT paper, exact, floor(exact) AS whole, row_number() OVER (ORDER BY exact - floor(exact) DESC, paper) AS place, {TOTAL} - count(*) OVER () - sum(floor(exact)) OVER () AS slack FROM e)
SELECT paper, CAST(1 + whole + CAST(place <= slack AS INT) AS BIGINT) AS quota FROM r"""


def largest_quotas(spark, sf_dir):
    return planning.largest_quotas(question_quotas(spark, sf_dir))


LARGEST = f"SELECT * FROM ({QUOTAS}) ORDER BY quota DESC, paper LIMIT 8"


def _by_source(spark, sf_dir):
    c = _screened(spark, sf_dir).drop("paper")
    d = data.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("arxiv_id"), F.col("source").alias("paper"))
    return c.join(d, "arxiv_id")


def question_pools(spark, sf_dir):
    return planning.pools(_by_source(spark, sf_dir))


POOLS = f"""{SCREENED}, s AS (SELECT d.source AS paper, chunk_id, reason = 'ok' AS usable, max(CAST(reason = 'ok' AS INT)) OVER (PARTITION BY d.source) AS any_usable FROM screened x JOIN documents d ON CAST(d.doc_id AS VARCHAR) = x.paper)
SELECT paper, chunk_id, CAST(row_number() OVER (PARTITION BY paper ORDER BY md5('{planning.SEED}:' || chunk_id), chunk_id) AS INT) AS place FROM s WHERE usable OR any_usable = 0"""


def question_draws(spark, sf_dir):
    used = data.chunks(spark, sf_dir).where(F.col("ordinal") == 1).select("chunk_id")
    return planning.draw(question_pools(spark, sf_dir), question_quotas(spark, sf_dir), used)


DRAWS = f"""WITH p AS ({POOLS}), u AS (SELECT paper, chunk_id, row_number() OVER (PARTITION BY paper ORDER BY place) AS spot FROM p WHERE chunk_id NOT LIKE '%::c1')
SELECT paper, chunk_id, CAST(row_number() OVER (ORDER BY spot, paper) AS INT) AS turn FROM u JOIN ({QUOTAS}) q USING (paper) WHERE spot <= quota"""


def _asks(spark, sf_dir):
    return data.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("question"))


def near_questions(spark, sf_dir):
    x = planning.near_questions(_asks(spark, sf_dir), 0.05)
    return x.withColumn("jaccard", F.round("jaccard", 9))


_stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"
NEAR = f"""WITH w AS (SELECT item_id AS idx, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_stop}, w))) AS w FROM benchmark),
j AS (SELECT b.idx, a.idx AS earlier_idx, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS jaccard FROM w a JOIN w b ON a.idx < b.idx)
SELECT idx, earlier_idx, round(jaccard, 9) AS jaccard FROM j WHERE jaccard >= 0.05"""


def accepted_questions(spark, sf_dir):
    return planning.accept(_asks(spark, sf_dir), 0.05)


ACCEPTED = f"""WITH RECURSIVE n AS ({NEAR}),
q AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r, coalesce(near, []) AS near FROM (SELECT item_id AS idx FROM benchmark) LEFT JOIN (SELECT idx, list_sort(list(earlier_idx)) AS near FROM n GROUP BY idx) USING (idx)),
go AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS idx, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS blocked_by
  UNION ALL
  SELECT q.r, q.idx, CASE WHEN len(list_intersect(q.near, go.taken)) = 0 THEN list_append(go.taken, q.idx) ELSE go.taken END, list_min(list_intersect(q.near, go.taken)) FROM go JOIN q ON q.r = go.r + 1)
SELECT idx, blocked_by IS NULL AS accepted, blocked_by FROM go WHERE r > 0"""


def specific_questions(spark, sf_dir):
    q = data.questions(spark, sf_dir)
    entity = F.when(F.col("item_id") % 5 == 0, F.lit("")).when(F.col("item_id") % 2 == 0, F.upper(F.substring_index("text", " ", 1))).otherwise(F.lit("no such entity"))
    return q.select("qid", T.is_specific(entity, F.col("text")).alias("specific"))


SPECIFIC = f"WITH {data.QUESTIONS} SELECT qid, item_id % 5 <> 0 AND item_id % 2 = 0 AS specific FROM questions"


def _candidates(spark, sf_dir):
    """Documents as papers that cite others by a rule; every third date doesn't parse."""
    d = data.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    date = F.when(i % 3 == 0, F.lit("someday")).otherwise(F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + i * 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    refs = F.array(*[x.cast("string") for x in (i * 7 % 1500, i * 13 % 900, i)])
    return d.select(i.cast("string").alias("arxiv_id"), F.col("source").alias("title"), date.alias("published"), F.when(i % 10 == 0, "anchor").otherwise("arxiv_search").alias("source"), refs.alias("ref_arxiv_ids"), i.alias("pos"))


CANDIDATES = """c AS (SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN 'someday' ELSE strftime(make_timestamp((1600000000 + doc_id * 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS published,
  CASE WHEN doc_id % 10 = 0 THEN 'anchor' ELSE 'arxiv_search' END AS source, [CAST(doc_id * 7 % 1500 AS VARCHAR), CAST(doc_id * 13 % 900 AS VARCHAR), CAST(doc_id AS VARCHAR)] AS refs, doc_id AS pos FROM documents),
edges AS (SELECT DISTINCT arxiv_id AS citing, cited FROM (SELECT arxiv_id, unnest(refs) AS cited FROM c) WHERE cited <> arxiv_id AND cited IN (SELECT arxiv_id FROM c)),
degrees AS (SELECT c.arxiv_id, coalesce(k, 0) AS degree FROM c LEFT JOIN (SELECT e AS arxiv_id, count(*) AS k FROM (SELECT citing AS e FROM edges UNION ALL SELECT cited FROM edges) GROUP BY 1) USING (arxiv_id))"""


def citation_edges(spark, sf_dir):
    return corpus.edges(_candidates(spark, sf_dir))


def citation_degrees(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return corpus.degrees(c, corpus.edges(c))


def isolated_papers(spark, sf_dir):
    return corpus.isolated(citation_degrees(spark, sf_dir))


def _keep(spark, sf_dir):
    return data.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("arxiv_id")).distinct()


def curated(spark, sf_dir):
    kept, dropped = corpus.curate(_candidates(spark, sf_dir), _keep(spark, sf_dir))
    return kept.select("arxiv_id", F.lit(True).alias("kept")).unionByName(dropped.select("arxiv_id", F.lit(False).alias("kept")))


KEPT = "kept AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS arxiv_id FROM labels WHERE quality = 1)"


def curated_edges(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return corpus.induced(corpus.edges(c), _keep(spark, sf_dir))


def review_lines(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return corpus.review(c, corpus.degrees(c, corpus.edges(c)))


def recent_papers(spark, sf_dir):
    return corpus.recent(_candidates(spark, sf_dir), corpus.cutoff(F.to_timestamp(F.lit("2022-06-01 00:00:00")), 1)).select("arxiv_id", "published")


def with_anchors(spark, sf_dir):
    c = _candidates(spark, sf_dir).select("arxiv_id", "source")
    return corpus.with_anchors(c.where("source = 'anchor'"), c)


def annotated(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    lookup = c.where("pos % 4 <> 0").select("arxiv_id", (F.col("pos") * 3).alias("citation_count"), F.col("ref_arxiv_ids"))
    return corpus.annotate(c, lookup).select("arxiv_id", "s2_found", "citation_count", F.size("ref_arxiv_ids").cast("long").alias("n_refs"))


def _manifest(spark, sf_dir):
    d = data.table(spark, sf_dir, "documents")
    files = d.where("doc_id % 9 <> 0").select(F.concat(F.lit("raw\\"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return corpus.manifest(d.select(F.col("doc_id").cast("string").alias("arxiv_id")), files)


def manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


MANIFEST = """m AS (SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, doc_id % 9 <> 0 AND strlen(text) > 0 AS ok, text FROM documents),
manifest AS (SELECT arxiv_id, CASE WHEN ok THEN 'ok' ELSE 'download_failed' END AS status, CASE WHEN ok THEN sha256(text) END AS sha256, CASE WHEN ok THEN strlen(text) END AS file_size_bytes, CASE WHEN NOT ok THEN 'missing' END AS error FROM m)"""


def manifest_totals(spark, sf_dir):
    return corpus.manifest_totals(_manifest(spark, sf_dir))


def chat_turns(spark, sf_dir):
    x = chat.turns(data.table(spark, sf_dir, "conversations"))
    return x.select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


TURNS = """x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, md5(text) AS question_md5, CASE WHEN r = 'assistant' THEN md5(t) END AS answer_md5 FROM x WHERE role = 'user')"""


def chat_undo(spark, sf_dir):
    return chat.undo(chat_turns(spark, sf_dir))


def url_names(spark, sf_dir):
    u = F.col("url")
    return data.table(spark, sf_dir, "pages").select("page_id", T.basename_stem(u).alias("stem"), T.paper_id(u).alias("paper"), T.preview(F.regexp_replace("html", "<[^>]*>", " ")).alias("preview"))


URLS = r"""SELECT page_id, regexp_replace(string_split(replace(url, '\', '/'), '/')[-1], '(?i)\.pdf$', '') AS stem, string_split(string_split(url, '/')[-1], 'v')[1] AS paper,
CASE WHEN length(t) > 320 THEN substr(t, 1, 320) || '...' ELSE t END AS preview FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)"""


def store_merge(spark, sf_dir):
    """Half the chunks, then all of those with odd ordinals again with another text."""
    c = data.chunks(spark, sf_dir).select("chunk_id", F.col("text").alias("page_content"), F.lit("local").alias("provider"))
    odd = c.where(F.expr("substring_index(chunk_id, 'c', -1) % 2 = 1"))
    text = lambda name: odd.withColumn("page_content", F.concat(F.lit(name), "page_content"))
    new = text("draft ").unionByName(text("new "))  # two rows of a key in one batch: the last one wins
    old = c.where(F.expr("substring_index(chunk_id, '::', 1) % 2 = 0"))
    return store.merge(old, new).select("chunk_id", F.substring(F.sha2("page_content", 256), 1, 8).alias("sha8"))


STORE = f"""WITH {data.CHUNKS} SELECT chunk_id, substr(sha256(CASE WHEN ordinal % 2 = 1 THEN 'new ' || text ELSE text END), 1, 8) AS sha8 FROM chunks WHERE ordinal % 2 = 1 OR CAST(arxiv_id AS BIGINT) % 2 = 0"""

_C = f"WITH {CANDIDATES}"
QUERIES = {
    "screened_chunks": (screened_chunks, SCREENED_CHUNKS),
    "screen_rejections": (screen_rejections, REJECTIONS),
    "question_quotas": (question_quotas, QUOTAS),
    "largest_quotas": (largest_quotas, LARGEST),
    "question_pools": (question_pools, POOLS),
    "question_draws": (question_draws, DRAWS),
    "near_questions": (near_questions, NEAR),
    "accepted_questions": (accepted_questions, ACCEPTED),
    "specific_questions": (specific_questions, SPECIFIC),
    "citation_edges": (citation_edges, f"{_C} SELECT citing, cited FROM edges"),
    "citation_degrees": (citation_degrees, f"{_C} SELECT arxiv_id, degree FROM degrees"),
    "isolated_papers": (isolated_papers, f"{_C} SELECT count(*) FILTER (WHERE degree = 0) AS n_isolated FROM degrees"),
    "curated": (curated, f"{_C}, {KEPT} SELECT arxiv_id, arxiv_id IN (SELECT arxiv_id FROM kept) AS kept FROM c"),
    "curated_edges": (curated_edges, f"{_C}, {KEPT} SELECT citing, cited FROM edges WHERE citing IN (SELECT arxiv_id FROM kept) AND cited IN (SELECT arxiv_id FROM kept)"),
    "review_lines": (review_lines, f"{_C} SELECT CAST(row_number() OVER (ORDER BY degree DESC, pos) AS INT) AS place, '| ' || arxiv_id || ' | ' || source || ' | ' || substr(published, 1, 4) || ' | ' || degree || ' | ' || title || ' |' AS line FROM c JOIN degrees USING (arxiv_id)"),
    "recent_papers": (recent_papers, f"{_C} SELECT arxiv_id, published FROM c WHERE coalesce(try_strptime(published, '%Y-%m-%dT%H:%M:%SZ') >= TIMESTAMP '2021-06-01', true)"),
    "with_anchors": (with_anchors, f"{_C} SELECT arxiv_id, source FROM c"),
    "annotated": (annotated, f"{_C} SELECT arxiv_id, pos % 4 <> 0 AS s2_found, CASE WHEN pos % 4 <> 0 THEN pos * 3 END AS citation_count, CASE WHEN pos % 4 <> 0 THEN len(refs) ELSE 0 END AS n_refs FROM c"),
    "manifest": (manifest, f"WITH {MANIFEST} SELECT * FROM manifest"),
    "manifest_totals": (manifest_totals, f"WITH {MANIFEST} SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status <> 'ok') AS n_failed, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS total_bytes FROM manifest"),
    "chat_turns": (chat_turns, f"WITH {TURNS} SELECT * FROM turns"),
    "chat_undo": (chat_undo, f"WITH {TURNS} SELECT conv_id, turn, question_md5, answer_md5 FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM turns) WHERE turn < last"),
    "url_names": (url_names, URLS),
    "store_merge": (store_merge, STORE),
}
