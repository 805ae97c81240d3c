"""Model-backed steps as columns: bounded concurrency in a task, retries, keys in turn, and a failure that is one row's alone.

A call gives a struct of value, error, attempts, seconds and tokens.  What a
failed call means is the caller's to say: the value is null then.  Calls may be
repeated when a task is, so providers must be idempotent.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.providers import AllKeysBlocked, KeyRotator, call_with_rotation

FIELDS = "value {kind}, error string, attempts int, seconds double, prompt_tokens long, output_tokens long"


@dataclass(frozen=True)
class Reply:
    """What a provider may return in place of the bare value, to have its tokens counted."""

    value: Any
    prompt_tokens: int = 0
    output_tokens: int = 0


def never_refused(error: Exception) -> float | None:
    return None


def always_transient(error: Exception) -> bool:
    return True


@dataclass(frozen=True)
class CallPolicy:
    concurrency: int = 8  # calls at once in a task
    waits: tuple[float, ...] = ()  # seconds before each further attempt
    deadline: float = 120.0  # seconds of one row's calls and waits, after which it has failed
    keys: tuple[str, ...] = ()  # given to the provider in turn as ``key=``, where there are any
    transient: Callable[[Exception], bool] = always_transient  # whether an error may pass
    refused: Callable[[Exception], float | None] = never_refused  # for how long an error blocks its key


def isolated(call: Callable[..., Any], args: Sequence[Any], policy: CallPolicy, rotator: KeyRotator | None = None, scope: str = "", sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict[str, Any]:
    """One call with its retries; never raises."""
    began, tries, error = clock(), 0, ""
    for wait in (*policy.waits, None):
        tries += 1
        try:
            found = call(*args) if rotator is None else call_with_rotation(lambda key: call(*args, key=key), rotator, scope, policy.refused)
            reply = found if isinstance(found, Reply) else Reply(found)
            return {"value": reply.value, "error": None, "attempts": tries, "seconds": clock() - began, "prompt_tokens": reply.prompt_tokens, "output_tokens": reply.output_tokens}
        except Exception as e:  # noqa: BLE001 - one row's failure is one row
            error = f"{type(e).__name__}: {e}"
            final = wait is None or isinstance(e, AllKeysBlocked) or not policy.transient(e) or clock() - began + wait > policy.deadline
            if final:
                break
            sleep(wait)
    return {"value": None, "error": error[:500], "attempts": tries, "seconds": clock() - began, "prompt_tokens": 0, "output_tokens": 0}


class Callers:
    """Daemon threads that make calls; one that hangs is given up at its row's deadline and replaced."""

    def __init__(self, call: Callable[..., Any], policy: CallPolicy, scope: str) -> None:
        self.call, self.policy, self.scope = call, policy, scope
        self.rotator = KeyRotator(list(policy.keys)) if policy.keys else None
        self.todo: queue.SimpleQueue = queue.SimpleQueue()
        for _ in range(policy.concurrency):
            self._start()

    def _start(self) -> None:
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while (job := self.todo.get()) is not None:
            job["began"] = time.monotonic()
            job["started"].set()
            job["result"] = isolated(self.call, job["args"], self.policy, self.rotator, self.scope)
            job["done"].set()
            if job.get("late"):
                return  # it was replaced

    def run(self, rows: list[tuple]) -> list[dict[str, Any]]:
        jobs = [{"args": row, "started": threading.Event(), "done": threading.Event()} for row in rows]
        for job in jobs:
            self.todo.put(job)
        out = []
        for job in jobs:
            job["started"].wait()
            if not job["done"].wait(max(0.0, job["began"] + self.policy.deadline - time.monotonic())):
                job["late"] = True
                self._start()
                out.append({"value": None, "error": f"DeadlineExceeded: {self.policy.deadline} s", "attempts": 1, "seconds": self.policy.deadline, "prompt_tokens": 0, "output_tokens": 0})
            else:
                out.append(job["result"])
        return out

    def close(self) -> None:
        for _ in range(self.policy.concurrency):
            self.todo.put(None)


def called(call: Callable[..., Any], kind: str, *columns: Column | str, policy: CallPolicy = CallPolicy(), scope: str = "") -> Column:
    """A struct of ``FIELDS`` for each row; ``call`` gets the row's values.  Whole Arrow batches are handed to the callers."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        callers = Callers(call, policy, scope)
        try:
            for batch in batches:
                columns = (batch,) if isinstance(batch, pd.Series) else batch  # one column comes without its tuple
                rows = callers.run(list(zip(*columns, strict=True)))
                yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object if c in ("value", "error") else None) for c in ("value", "error", "attempts", "seconds", "prompt_tokens", "output_tokens")})
        finally:
            callers.close()

    return F.pandas_udf(run, FIELDS.format(kind=kind))(*columns)


#: Stages in the order in which a question passes them; those after retrieval see its parts, named question/part.
ORDER = ("input_guardrail", "query_history", "decomposition", "query_expansion", "sufficiency", "web_query", "web_search", "rerank", "generation", "verification")
OF_PARTS = ("query_expansion", "sufficiency", "web_query", "web_search", "rerank")


def log_of(rows: DataFrame, stage: str, call: str, key: str = "qid") -> DataFrame:
    """qid, stage, error, attempts, seconds, prompt_tokens, output_tokens of the calls in a saved table."""
    fields = [F.col(f"{call}.{c}").alias(c) for c in ("error", "attempts", "seconds", "prompt_tokens", "output_tokens")]
    qid = F.col(key).cast("string")
    if stage in OF_PARTS:
        qid = F.regexp_replace(qid, r"/\d+$", "")
    return rows.filter(F.col(call).isNotNull()).select(qid.alias("qid"), F.lit(stage).alias("stage"), *fields)


def events(calls: DataFrame) -> DataFrame:
    """qid, seq, stage, status (completed or failed), duration_ms: one row a question and stage, from its calls; durations are those of the calls added up."""
    number = F.create_map(*[F.lit(x) for i, name in enumerate(ORDER) for x in (name, i)])
    done = calls.groupBy("qid", "stage").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"), F.round(F.sum("seconds") * 1000, 1).alias("duration_ms"))
    return done.select("qid", number[F.col("stage")].alias("seq"), "stage", F.when(F.col("bad"), "failed").otherwise("completed").alias("status"), "duration_ms")


def usage(calls: DataFrame) -> DataFrame:
    """stage, calls, failures, retries, prompt_tokens, output_tokens, seconds."""
    return calls.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.sum(F.col("attempts") - 1).alias("retries"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("seconds"), 3).alias("seconds"),
    )
