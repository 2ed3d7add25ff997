"""Language-model completions as a source.

Offline, replies come from a table keyed by the hash of the prompt. Live, a provider is called within
tasks, and its replies are written to such a table, so that no plan asks twice.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "prompt_hash string, model string, status string, finish_reason string, raw string"


@dataclass(frozen=True)
class Retry:
    """Attempts, and seconds to wait after a reply that isn't JSON, a rate limit, or another failure; `growth` times longer each time."""

    attempts: int = 3
    bad_reply: float = 1.0
    rate_limit: float = 60.0
    other: float = 2.0
    growth: float = 1.0

    def wait(self, error: str, attempt: int = 0) -> float:
        first = self.bad_reply if error == BAD_REPLY else self.rate_limit if "rate" in error.lower() or "429" in error else self.other
        return first * self.growth**attempt


#: Searches and fetches wait longer each time.
SEARCH, FETCH = Retry(4, 5.0, 5.0, 5.0, 2.0), Retry(4, 3.0, 3.0, 3.0, 2.0)
BAD_REPLY = "not JSON"


def holds_json(raw: str) -> bool:
    """Whether a reply has an object between fences, or from its first to its last brace."""
    fenced = re.search(r"(?s)```(?:json)?\s*(\{.*?\})\s*```", raw or "")
    text = fenced[1] if fenced else (raw or "")[(raw or "").find("{"):(raw or "").rfind("}") + 1]
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(system, F.lit("")), F.lit("\n"), F.coalesce(user, F.lit(""))), 256)


def replay(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """prompts (…, system, user, model) with status and raw; a cut or missing reply is a failure with a null text."""
    asked = prompts.withColumn("prompt_hash", prompt_hash(F.col("system"), F.col("user")))
    met = asked.join(completions.select(*(c.split()[0] for c in SCHEMA.split(", "))), ["prompt_hash", "model"], "left")
    cut = F.col("finish_reason") == "max_tokens"
    status = F.when(F.col("status").isNull(), "missing").when(cut, "truncated").otherwise(F.col("status"))
    return met.withColumn("status", status).withColumn("raw", F.when(F.col("status") == "ok", F.col("raw"))).drop("finish_reason")


REPLY = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])


def answer(row: dict, call, retry: Retry, sleep: Callable[[float], None], wants_json: bool, busy: Callable[[float], None] = lambda _: None) -> dict:
    """The completion of one prompt, asked for up to retry.attempts times; busy hears of waits after a rate limit."""
    status, reason, raw = "failed", None, None
    for attempt in range(retry.attempts):
        try:
            raw, reason = call(row["model"], row["system"], row["user"])
            if not wants_json or reason == "max_tokens" or holds_json(raw):
                status = "ok"
                break
            reason = BAD_REPLY
        except Exception as e:  # a service's failures are of any kind; the row records them
            reason = str(e)[:200]
        if attempt + 1 < retry.attempts:
            wait = retry.wait(reason, attempt)
            if wait == retry.rate_limit:
                busy(wait)
            sleep(wait)
    return {"prompt_hash": row["prompt_hash"], "model": row["model"], "status": status, "finish_reason": reason, "raw": raw}


def complete(prompts: DataFrame, call: Callable[[str, str, str], tuple[str, str]], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, wants_json: bool = True) -> DataFrame:
    """Ask `call(model, system, user) -> (text, finish_reason)` for each distinct prompt within tasks.

    With wants_json, a reply without a readable JSON object is asked for again like a failed call; the
    row of one that never came has the status failed and its last reply.
    """
    asked = prompts.select("model", "system", "user", prompt_hash(F.col("system"), F.col("user")).alias("prompt_hash")).dropDuplicates(["model", "prompt_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([answer(row, call, retry, sleep, wants_json) for row in batch.to_pylist()], REPLY)

    return asked.mapInArrow(run, SCHEMA)
