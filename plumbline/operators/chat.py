"""Answers from retrieved chunks, and the history of a conversation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.fusion import CHAT_K
from plumbline.operators.retriever import Retriever
from plumbline.session import prepare
from plumbline.sources.store import PROVIDERS

PROMPT = "Answer the question from the context alone; say so if it doesn't hold the answer.\n\nContext:\n{context}\n\nQuestion: {question}"


def ping() -> str:
    return "ok"


def providers() -> list[str]:
    return sorted(p.title() for p in PROVIDERS)


def models(provider: str) -> list[str]:
    """Unknown provider: an error."""
    if provider.lower() not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    return PROVIDERS[provider.lower()]


def check_model(provider: str, model: str) -> None:
    if model not in models(provider):
        raise ValueError(f"{provider} has no model {model!r}")


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions (qid, text), hits (qid, rank, page_content): qid, prompt with the contexts in order, and contexts."""
    held = hits.where("page_content is not null").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_content"))), lambda h: h["page_content"]).alias("contexts"))
    x = questions.join(held, "qid", "left").withColumn("contexts", F.coalesce("contexts", F.expr("cast(array() as array<string>)")))
    head, rest = PROMPT.split("{context}")
    between = rest.split("{question}")[0]
    return x.select("qid", F.concat(F.lit(head), F.array_join("contexts", "\n\n"), F.lit(between), "text").alias("prompt"), "contexts")


def answer(questions: DataFrame, hits: DataFrame, model: Callable[[pd.Series], pd.Series], include_context: bool = False) -> DataFrame:
    """qid, answer, and contexts on request. model: prompts to answers, a batch at a time."""
    x = prompts(questions, hits).withColumn("answer", F.pandas_udf(lambda prompts: model(prompts), "string")("prompt"))
    return x.select("qid", "answer", *(["contexts"] if include_context else []))


def turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, turn, question, answer: each question with the reply to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = conversations.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return x.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("answer"))


def append(history: DataFrame, new: DataFrame) -> DataFrame:
    """history (conv_id, turn, question, answer) with new (conv_id, question, answer, in the order of their column at)
    behind each conversation's last turn."""
    prepare(history.sparkSession)
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    x = new.join(last, "conv_id", "left").withColumn("turn", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))).cast(history.schema["turn"].dataType))
    return history.unionByName(x.select(*history.columns))


def undo(history: DataFrame) -> DataFrame:
    """History without the last turn of each conversation."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    return history.join(last, "conv_id").where("turn < _last").drop("_last")


def clear(history: DataFrame, conversations: DataFrame) -> DataFrame:
    """History without these conversations."""
    return history.join(conversations.select("conv_id"), "conv_id", "left_anti")


def respond(retriever: Retriever, questions: DataFrame, provider: str, model_name: str, model: Callable[[pd.Series], pd.Series], mode: str | None = None, include_context: bool = False) -> DataFrame:
    """questions (qid, text, embedding) -> qid, answer, and contexts on request: CHAT_K chunks a question by the mode, in
    order, then the model. Unknown providers, models and modes are errors."""
    check_model(provider, model_name)
    hits = retriever.search(questions, CHAT_K, mode)
    return answer(questions.select("qid", "text"), hits.select("qid", "rank", "page_content"), model, include_context)


def model_table(spark: SparkSession) -> DataFrame:
    """provider, model: every pair that check_model() lets pass."""
    return spark.createDataFrame([(p, m) for p in PROVIDERS for m in PROVIDERS[p]], "provider string, model string")


def ready(provider: Column, model: Column, n_chunks: Column) -> Column:
    return provider.isNotNull() & model.isNotNull() & (n_chunks > 0)
