"""Question sets written by a model: round after round one chunk a paper, refilled from the same paper when one is refused."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import calls, chunking, golden, planning, ranks
from plumbline.session import prepare
from plumbline.sources import saved

ASK = 'Write one question that this passage alone answers and that names a method, model or data set of it. Reply with a JSON object: question, answer, entity (the name), or skip (true) and reason.\n\nPASSAGE:\n{text}'
CHECK = 'Does the passage answer the question? Reply with a JSON object: answers (true or false), reason.\n\nQUESTION: {question}\n\nPASSAGE:\n{text}'
TRIED = "paper string, place int, chunk_id string, outcome string, question string, answer string, entity string, turn int"
ACCEPTED = "accepted"
#: So many rows of a round are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


@dataclass
class Generated:
    """questions: as golden.QUESTIONS, with jaccard and flagged; skipped: paper, chunk_id, why; stopped: the quota is spent."""

    questions: DataFrame
    skipped: DataFrame
    stopped: bool


def _prompt(template: str, **columns: Column) -> Column:
    parts = []
    while "{" in template:
        head, rest = template.split("{", 1)
        name, template = rest.split("}", 1)
        parts += [F.lit(head), columns[name]]
    return F.concat(*parts, F.lit(template))


def generate(pool: DataFrame, quotas: DataFrame, chunks: DataFrame, model: Callable[[str], str], used: DataFrame | None = None, least: float = planning.NEAR, specific: bool = True, with_neighbours: bool = True, prefix: str = "g", tries: int = calls.TRIES, sleep: Callable[[float], None] = time.sleep) -> Generated:
    """pool (paper, chunk_id, place), quotas (paper, quota), chunks (chunk_id, arxiv_id, page, ordinal, text, text_sha8).

    Each round asks the model about the next chunk of every paper that is short of its quota, all at once. A chunk is
    refused if there is no JSON reply, if the model skips it, if the question is empty or (with specific) doesn't name
    its entity, if its own passage doesn't answer it, or if it is near an accepted one, of this round by paper. A
    refusal only moves that paper on, so its next chunk is asked about next round; rounds end when all quotas are met
    or all pools used up. A spent daily quota ends the run with what is accepted so far. Neighbouring chunks that answer
    a question too join its gold."""
    spark = prepare(pool.sparkSession)
    path = saved.folder(spark, "generate")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def held(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    texts = chunks.select("chunk_id", "text")
    # Every round reads the pool and the quotas, so they are computed once; texts are met by the few rows of a round.
    fresh = pool if used is None else pool.join(used.select("chunk_id").distinct(), "chunk_id", "left_anti")
    fresh, quotas = keep(fresh.select("paper", "place", "chunk_id"), "fresh"), keep(quotas.select("paper", "quota"), "quotas")
    papers = quotas.count()
    tried, turn, stopped = [spark.createDataFrame([], TRIED)], 0, False
    while not stopped:
        turn += 1
        so_far = reduce(DataFrame.union, tried)
        ahead = so_far.groupBy("paper").agg(F.max("place").alias("cursor"), F.count_if(F.col("outcome") == ACCEPTED).alias("have"))
        open_ = quotas.join(ahead, "paper", "left").where(F.coalesce("have", F.lit(0)) < F.col("quota")).select("paper", F.coalesce("cursor", F.lit(0)).alias("cursor"))
        open_ = F.broadcast(open_) if papers <= BROADCAST_ROWS else open_
        next_ = fresh.join(open_, "paper").where("place > cursor").groupBy("paper").agg(F.min(F.struct("place", "chunk_id")).alias("n")).select("paper", "n.place", "n.chunk_id")
        drawn = keep(texts.join(held(keep(next_, f"next-{turn}")), "chunk_id"), f"drawn-{turn}")
        if drawn.isEmpty():
            break
        replies = keep(calls.ask(drawn.select(F.col("chunk_id").alias("key"), _prompt(ASK, text=F.col("text")).alias("prompt")), model, tries, sleep), f"replies-{turn}")
        stopped = calls.any_quota(replies)
        said = lambda name: F.trim(F.coalesce(F.get_json_object("reply", f"$.{name}"), F.lit("")))
        x = drawn.join(replies.withColumnRenamed("key", "chunk_id"), "chunk_id").where(F.col("status") != calls.QUOTA)
        x = x.select("paper", "place", "chunk_id", "text", "status", said("skip").alias("skip"), said("reason").alias("reason"), said("question").alias("question"), said("answer").alias("answer"), said("entity").alias("entity"))
        why = F.when(F.col("status") == calls.FAILED, "no reply").when(F.col("skip") == "true", F.concat(F.lit("skipped: "), "reason")).when(F.col("question") == "", "empty question")
        why = why.when(F.lit(specific) & ~T.is_specific(F.col("entity"), F.col("question")), "names no entity")
        x = keep(x.withColumn("outcome", why), f"screened-{turn}")
        checks = keep(calls.ask(x.where("outcome is null").select(F.col("chunk_id").alias("key"), _prompt(CHECK, question=F.col("question"), text=F.col("text")).alias("prompt")), model, tries, sleep), f"checks-{turn}")
        stopped = stopped or calls.any_quota(checks)
        yes = checks.select(F.col("key").alias("chunk_id"), F.col("status").alias("checked"), F.coalesce(F.get_json_object("reply", "$.answers") == "true", F.lit(False)).alias("yes"))
        x = x.join(yes, "chunk_id", "left").where(F.coalesce(F.col("checked") != calls.QUOTA, F.lit(True)))
        x = x.withColumn("outcome", F.when(F.col("outcome").isNull() & ~F.col("yes"), "its passage doesn't answer it").otherwise(F.col("outcome")))
        # Near ones: those accepted before stand first, then this round's by paper.
        before = so_far.where(F.col("outcome") == ACCEPTED).select("turn", "paper", "question")
        order = F.format_string("%09d %s", "turn", "paper")
        asked = before.union(x.where("outcome is null").select(F.lit(turn).alias("turn"), "paper", "question")).select(order.alias("idx"), "question")
        near = planning.accept(asked, least).select(F.col("idx").alias("_idx"), "accepted", "blocked_by")
        x = x.withColumn("turn", F.lit(turn)).join(near, order == F.col("_idx"), "left")
        x = x.withColumn("outcome", F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("accepted"), ACCEPTED).otherwise(F.concat(F.lit("near "), "blocked_by")))
        tried.append(keep(x.select("paper", "place", "chunk_id", "outcome", "question", "answer", "entity", "turn"), f"tried-{turn}"))

    done = reduce(DataFrame.union, tried)
    accepted = done.where(F.col("outcome") == ACCEPTED)
    groups = accepted.select("chunk_id", F.col("chunk_id").alias("member"))
    if with_neighbours and not stopped:
        beside = keep(chunking.neighbours(chunks).join(held(accepted.select("chunk_id", "question")), "chunk_id"), "pairs")
        beside = texts.withColumnRenamed("chunk_id", "neighbour_id").join(held(beside), "neighbour_id")
        beside = keep(beside.withColumn("key", F.concat_ws(" ", "chunk_id", "neighbour_id")), "beside")
        also = keep(calls.ask(beside.select("key", _prompt(CHECK, question=F.col("question"), text=F.col("text")).alias("prompt")), model, tries, sleep), "also")
        stopped = calls.any_quota(also)  # what its own passage answers stays
        yes = also.where(F.coalesce(F.get_json_object("reply", "$.answers") == "true", F.lit(False)))
        groups = groups.union(beside.join(yes.select("key"), "key").select("chunk_id", F.col("neighbour_id").alias("member")))
    shas = chunks.select(F.col("chunk_id").alias("member"), "text_sha8")
    gold = groups.join(shas, "member").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("member", "text_sha8"))).alias("g"))  # a chunk and two neighbours at most
    leaks = golden.leakage(accepted.select(F.col("chunk_id").alias("qid"), "question", "chunk_id"), chunks.join(held(accepted.select("chunk_id")), "chunk_id", "left_semi")).select("chunk_id", "jaccard", "flagged")
    numbered = ranks.numbered(accepted, [F.col("turn"), F.col("paper")], "n").join(gold, "chunk_id").join(leaks, "chunk_id")
    members = F.transform("g", lambda m: m["member"])
    questions = numbered.select(
        F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 4, "0")).alias("qid"), "question", F.lit("any_of").alias("semantics"), F.array(F.struct(members.alias("chunk_ids"), F.lit("source passage and neighbours that answer it").alias("note"))).alias("gold_groups"),
        F.col("answer").alias("expected_answer"), F.array("paper").alias("source_papers"), F.lit("llm_generated").alias("provenance"), F.array(F.lit("bulk")).alias("tags"), F.map_from_arrays(members, F.transform("g", lambda m: m["text_sha8"])).alias("chunk_text_sha8"), "jaccard", "flagged",
    )
    return Generated(questions, done.where(F.col("outcome") != ACCEPTED).select("paper", "chunk_id", F.col("outcome").alias("why")), stopped)
