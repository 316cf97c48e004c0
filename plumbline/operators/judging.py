"""Verdicts of a judge model: prompts, cache, aggregates, and agreement with people."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions import text as T
from plumbline.session import prepare

PROMPT_VERSION = "v1"
VERDICT = "groundedness int, answer_correctness int, unsupported_claims array<string>, rationale string"
PROMPT = (
    "Compare an answer with the contexts it was given. Reply with one JSON object: groundedness (1 to 5: how far the contexts support it), "
    "answer_correctness (1 to 5), unsupported_claims (list of strings), rationale.\n\nQUESTION:\n{question}\n\nCONTEXTS:\n{contexts}\n\nANSWER:\n{answer}\n\n{expected}"
)


@F.pandas_udf(StringType())
def cache_key(question: pd.Series, answer: pd.Series, contexts: pd.Series) -> pd.Series:
    """Of the key-sorted JSON of what a verdict depends on."""
    make = lambda q, a, c: hashlib.sha256(json.dumps({"q": q, "a": a, "c": list(c), "p": PROMPT_VERSION}, sort_keys=True).encode()).hexdigest()
    return pd.Series([make(q, a, c) for q, a, c in zip(question, answer, contexts, strict=True)], dtype=object)


def prompt(question: Column, answer: Column, contexts: Column, expected: Column) -> Column:
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    reference = F.when(F.coalesce(expected, F.lit("")) != "", F.concat(F.lit("EXPECTED ANSWER:\n"), expected)).otherwise("")
    head, rest = PROMPT.split("{question}")
    between, rest = rest.split("{contexts}")
    then, rest = rest.split("{answer}")
    return F.concat(F.lit(head), question, F.lit(between), numbered, F.lit(then), answer, F.lit(rest.split("{expected}")[0]), reference)


def parse_verdict(raw: Column) -> Column:
    """struct of VERDICT from a reply; null if it holds no valid JSON object."""
    return F.from_json(T.json_part(T.message_text(raw)), VERDICT)


def judge(answers: DataFrame, model: Callable[[pd.Series], pd.Series], name: str, cache: DataFrame | None = None) -> DataFrame:
    """answers (qid, question, answer, contexts, expected_answer) -> qid, key, the fields of VERDICT, judge_model, raw and
    cached. model: prompts to replies, a batch at a time; asked only for what the cache (key, ...) lacks."""
    prepare(answers.sparkSession)
    x = answers.withColumn("key", cache_key("question", "answer", "contexts"))
    fresh = x if cache is None else x.join(cache.select("key"), "key", "left_anti")
    ask = F.pandas_udf(lambda prompts: model(prompts), "string")
    new = fresh.withColumn("raw", ask(prompt(F.col("question"), F.col("answer"), F.col("contexts"), F.col("expected_answer")))).withColumn("_v", parse_verdict(F.col("raw")))
    new = new.select("qid", "key", "_v.*", F.lit(name).alias("judge_model"), F.substring("raw", 1, 2000).alias("raw"), F.lit(False).alias("cached"))
    if cache is None:
        return new
    old = x.select("qid", "key").join(cache.drop("qid", "cached"), "key").withColumn("cached", F.lit(True))
    return new.unionByName(old.select(*new.columns))


def aggregate(verdicts: DataFrame) -> DataFrame:
    """One row: n, mean scores, shares fully and hardly grounded, models, whether several judged."""
    share = lambda c: F.count_if(c) / F.count("*")
    models = F.countDistinct("judge_model")
    return verdicts.agg(
        F.count("*").alias("n"), F.avg("groundedness").alias("mean_groundedness"), F.avg("answer_correctness").alias("mean_answer_correctness"),
        share(F.col("groundedness") == 5).alias("pct_fully_grounded"), share(F.col("groundedness") <= 2).alias("pct_ungrounded"), models.alias("n_models"), (models > 1).alias("judge_pool_blended"),
    ).where("n > 0")


def per_model(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("judge_model").agg(F.count("*").alias("n"))


def shared_labels(human: DataFrame, machine: DataFrame) -> DataFrame:
    """id, human, machine of items that both (id, label) have."""
    return human.select("id", F.col("label").alias("human")).join(machine.select("id", F.col("label").alias("machine")), "id")


def kappa(pairs: DataFrame) -> DataFrame:
    """n, observed, expected, kappa of (human, machine) pairs; 1 if chance agreement is certain; none: an error."""
    sides = pairs.select(F.explode(F.array(F.struct(F.lit("h").alias("side"), F.col("human").alias("label")), F.struct(F.lit("m").alias("side"), F.col("machine").alias("label")))).alias("s")).select("s.*")
    margins = sides.groupBy("label").agg(F.count_if(F.col("side") == "h").alias("h"), F.count_if(F.col("side") == "m").alias("m"))
    chance = margins.agg(F.sum(F.col("h").cast("double") * F.col("m")).alias("hm"))
    x = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("human") == F.col("machine")).alias("same")).crossJoin(F.broadcast(chance))
    x = x.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no shared labels")).cast("long")).otherwise(F.col("n")))
    x = x.withColumn("observed", F.col("same") / F.col("n")).withColumn("expected", F.col("hm") / (F.col("n").cast("double") * F.col("n")))
    return x.select("n", "observed", "expected", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))).alias("kappa"))


def agreement(pairs: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row: exact and near agreement, mean absolute error, kappa, and of what people rejected (2 or less) how much the
    judge rejected too; null if people rejected nothing."""
    gap, bad = F.abs(F.col("human") - F.col("machine")), F.col("human") <= 2
    x = pairs.agg(
        F.avg((gap == 0).cast("double")).alias("exact_agreement"), F.avg((gap <= tolerance).cast("double")).alias("within_agreement"), F.avg(gap).alias("mean_absolute_error"),
        F.count_if(bad).alias("n_human_rejected"), F.count_if(bad & (F.col("machine") <= 2)).alias("n_judge_also_rejected"),
    )
    return kappa(pairs).select("n", F.col("kappa").alias("cohens_kappa")).crossJoin(F.broadcast(x)).withColumn("rejection_recall", F.try_divide("n_judge_also_rejected", "n_human_rejected"))


def disagreements(pairs: DataFrame, tolerance: int = 1) -> DataFrame:
    return pairs.where(F.abs(F.col("human") - F.col("machine")) > tolerance)


def discriminates(model: Callable[[pd.Series], pd.Series]) -> tuple[bool, str]:
    """Whether a judge rejects an answer that its context doesn't support; a few words, on the driver."""
    text = PROMPT.format(question="Which method is used?", contexts="[1] Ranking is by term weights alone.", answer="A vision network trained for a month.", expected="EXPECTED ANSWER:\nTerm weights.")
    try:
        raw = str(model(pd.Series([text])).iloc[0])
        found = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
        score = int(found.get("groundedness", 5))
    except (ValueError, KeyError) as e:
        return False, f"no verdict: {e}"
    return score <= 2, f"groundedness {score} of an unsupported answer"
