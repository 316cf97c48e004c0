"""Calls to a language model that the caller passes in: replies as JSON, retries, and a stop when a daily quota is spent."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a spent quota says, and the seconds before a further try.
DAILY = ("tokens per day", "requests per day", " tpd")
WAIT, TRIES = 5, 3
REPAIR = "\n\nThe last reply was no JSON object. Reply with one JSON object and nothing else."
OK, FAILED, QUOTA = "ok", "failed", "quota"


def parse(reply: str) -> dict | None:
    """From the first { to the last }, if that is a JSON object."""
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        value = json.loads(found.group(0)) if found else None
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) else None


def call(model: Callable[[str], str], prompt: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, dict | None, str]:
    """(OK, FAILED or QUOTA, the object, what went wrong). A reply that isn't JSON is asked for again, an error after a
    longer wait each time; a daily quota won't come back, so it ends the call at once."""
    why = ""
    for turn in range(tries):
        try:
            found = parse(model(prompt))
            if found is not None:
                return OK, found, ""
            prompt, why = prompt + REPAIR, "no JSON"
        except Exception as e:  # whatever a service raises
            why = str(e)
            if any(d in why.lower() for d in DAILY):
                return QUOTA, None, why
            sleep(WAIT * (turn + 1))
    return FAILED, None, why


def ask(prompts: DataFrame, model: Callable[[str], str], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts (key, prompt) -> key, status, reply (JSON), why. Once the quota is spent a task asks no more."""
    kind = prompts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = ""
        for b in batches:
            rows = []
            for key, prompt in zip(b["key"], b["prompt"], strict=True):
                status, found, why = (QUOTA, None, spent) if spent else call(model, prompt, tries, sleep)
                spent = why if status == QUOTA else ""
                rows.append((key, status, None if found is None else json.dumps(found), why))
            yield pd.DataFrame(rows, columns=["key", "status", "reply", "why"])

    return prompts.select("key", "prompt").mapInPandas(run, f"key {kind}, status string, reply string, why string")


def any_quota(replies: DataFrame) -> bool:
    return not replies.where(F.col("status") == QUOTA).isEmpty()
