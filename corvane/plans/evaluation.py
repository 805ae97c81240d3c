"""A checkpointed evaluation run: micro-batches of questions are answered and judged, and each is a version of the run's table.

A run that ends, for whatever reason, keeps the batches that were committed;
begun again it asks what is left.  It stops by itself after so many questions,
or at the first batch in which a call failed; a question that failed is
recorded and asked again by the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import runs
from corvane.plans.engine import Engine
from corvane.plans.providers import overlap_score
from corvane.plans.stages import CallPolicy, called
from corvane.sources.tables import saved
from corvane.sources.versions import VersionedTable


def overlap_judge(question: str, answer: str | None, reference: str | None) -> str:
    """Stand-in for a judge: shares of words, as JSON."""
    return json.dumps({"correctness_overlap": overlap_score(reference or "", answer or ""), "relevancy_overlap": overlap_score(question, answer or "")})


@dataclass(frozen=True)
class RunConfig:
    batch: int = 8  # questions between two checkpoints
    most: int | None = None  # questions of this run
    stop_on_error: bool = True
    judge: Callable[[str, str | None, str | None], str] = overlap_judge
    judge_policy: CallPolicy = CallPolicy()  # its keys are judged with in turn


@dataclass(frozen=True)
class RunReport:
    asked: int
    failed: int
    left: int
    stopped: str | None  # why, where questions are left


class EvaluationRun:
    def __init__(self, store: VersionedTable, engine: Engine, settings: dict[str, str], config: RunConfig = RunConfig()) -> None:
        """Begins a run, or goes on with the one in ``store``; other settings than it began with are refused."""
        self.store, self.engine, self.config = store, engine, config
        begun = store.manifest()
        if begun["version"] == 0:
            store.commit(0, [], {"settings": settings})
        else:
            make = lambda d: engine.spark.createDataFrame(sorted(d.items()), "key string, value string")
            nothing = engine.spark.createDataFrame([], "id string")
            runs.resume(nothing, nothing, make(begun["info"]["settings"]), make(settings))

    def records(self) -> DataFrame:
        """The last record of each question: id, question, status, answer, groundedness, error, scores, turn."""
        rows = self.store.table()
        if rows is None:
            return self.engine.spark.createDataFrame([], "id string, question string, status string, answer string, groundedness double, error string, scores map<string,double>, turn int")
        last = Window.partitionBy("id").orderBy(F.desc("turn"))
        return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")

    def run(self, questions: DataFrame) -> RunReport:
        """Asks the questions (id, question, reference, ordinal) that have no record without an error yet."""
        config, asked, failed = self.config, 0, 0
        todo = saved(runs.pending(questions, self.records().filter("error IS NULL").select("id")).select("id", "question", "reference", "ordinal"), "run-todo")
        total = todo.count()
        while True:
            room = config.batch if config.most is None else min(config.batch, config.most - asked)
            state = self.store.manifest()
            turn = state["version"]
            # what this run has not asked yet, whether it went well or not
            batch = todo.orderBy("ordinal", "id").offset(asked).limit(room) if room > 0 else None
            batch = saved(batch, "run-batch") if batch is not None else None
            n = batch.count() if batch is not None else 0
            if batch is None or n == 0:
                return RunReport(asked, failed, total - asked + failed, "limit" if asked < total else "errors" if failed else None)
            records, bad = self._records(batch, turn)
            self.store.commit(turn, [*state["parts"], self.store.write_part(records)], state["info"])
            asked, failed = asked + n, failed + bad
            if bad and config.stop_on_error:
                return RunReport(asked, failed, total - asked + failed, "error")

    def _records(self, batch: DataFrame, turn: int) -> tuple[DataFrame, int]:
        results, after = self.engine.run(batch.select(F.col("id").alias("qid"), "question"), bypass_cache=True)
        errors = after.calls.filter("error IS NOT NULL").groupBy(F.col("qid").alias("id")).agg(F.min(F.concat_ws(": ", "stage", "error")).alias("call_error"))
        rows = batch.join(results.select(F.col("qid").alias("id"), "status", "answer", "groundedness"), "id")
        verdict = called(self.config.judge, "string", "question", "answer", "reference", policy=self.config.judge_policy, scope="judge")
        rows = saved(rows.withColumn("judged", verdict).join(errors, "id", "left"), "run-judged")
        judge_error = F.when(F.col("judged.error").isNotNull(), F.concat(F.lit("judge: "), F.col("judged.error")))
        # an optional step that failed had a fallback: only what left no answer or no score is an error of the question
        error = F.coalesce(F.when(F.col("status") == "failed", F.coalesce("call_error", F.lit("generation"))), judge_error)
        scores = F.from_json("judged.value", "map<string,double>")
        records = rows.select("id", "question", "status", "answer", "groundedness", error.alias("error"), scores.alias("scores"), F.lit(turn).alias("turn"))
        records = saved(records, "run-records")
        return records, records.filter("error IS NOT NULL").count()
