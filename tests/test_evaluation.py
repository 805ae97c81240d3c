"""The checkpointed evaluation run: batches, interruption, errors, limits and settings."""

import pytest
from pyspark.sql import functions as F
from test_plans import TEXTS
from test_stages import failing

from corvane.plans.engine import Engine
from corvane.plans.evaluation import EvaluationRun, RunConfig
from corvane.plans.stages import CallPolicy, usage
from corvane.sources.versions import VersionedTable

QUESTIONS = [("a", "When is the monthly rent due?", "on the first day", 1), ("b", "Where are dogs allowed?", "in the garden", 2), ("c", "hello", None, 3)]


class Scripted:
    """An engine that answers from a script: what the loop around it needs, without its plan."""

    def __init__(self, spark, bad=()):
        self.spark, self.bad = spark, list(bad)

    def run(self, asked, bypass_cache=False):
        assert bypass_cache
        bad = F.col("qid").isin(self.bad) if self.bad else F.lit(False)
        results = asked.select("qid", F.when(bad, "failed").otherwise("answered").alias("status"), F.when(~bad, "on the first day").alias("answer"), F.lit(1.0).alias("groundedness"))
        after = Scripted(self.spark, self.bad)
        after.calls = asked.filter(bad).select("qid", F.lit("generation").alias("stage"), F.lit("RuntimeError: 503").alias("error"))
        return results, after


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "id string, question string, reference string, ordinal int")


def test_a_run_goes_on_where_it_was_left(spark, questions, tmp_path):
    store, settings, engine = VersionedTable(spark, str(tmp_path / "r")), {"top_k": "20"}, Scripted(spark)
    first = EvaluationRun(store, engine, settings, RunConfig(batch=1, most=1)).run(questions)
    assert (first.asked, first.left, first.stopped) == (1, 2, "limit")
    stopped = EvaluationRun(store, Scripted(spark, ["b"]), settings, RunConfig(batch=1)).run(questions)
    assert (stopped.asked, stopped.failed, stopped.left, stopped.stopped) == (1, 1, 2, "error")
    run = EvaluationRun(store, engine, settings, RunConfig(batch=8))
    assert {r.id: r.error for r in run.records().collect()} == {"a": None, "b": "generation: RuntimeError: 503"}
    last = run.run(questions)
    assert (last.asked, last.failed, last.left, last.stopped) == (2, 0, 0, None)
    out = {r.id: r for r in run.records().collect()}
    assert set(out) == {"a", "b", "c"} and out["a"].scores["correctness_overlap"] == 1.0 and out["b"].status == "answered"
    assert run.run(questions).asked == 0
    with pytest.raises(ValueError, match="top_k"):
        EvaluationRun(store, engine, {"top_k": "10"})


def test_all_batches_where_errors_do_not_stop(spark, questions, tmp_path):
    run = EvaluationRun(VersionedTable(spark, str(tmp_path / "r")), Scripted(spark, ["a"]), {}, RunConfig(batch=1, stop_on_error=False))
    report = run.run(questions)
    assert (report.asked, report.failed, report.left, report.stopped) == (3, 1, 1, "errors") and len(run.store.versions()) == 4


def test_judges_rotate_and_their_failure_is_recorded(spark, questions, tmp_path):
    def judge(question, answer, reference, key):
        if key == "k1":
            raise RuntimeError("429")
        return '{"score": 1.0}'

    policy = CallPolicy(keys=("k1", "k2"), refused=lambda e: 60.0)
    run = EvaluationRun(VersionedTable(spark, str(tmp_path / "a")), Scripted(spark), {}, RunConfig(judge=judge, judge_policy=policy))
    assert run.run(questions.filter("id = 'a'")).failed == 0 and run.records().first().scores == {"score": 1.0}
    run = EvaluationRun(VersionedTable(spark, str(tmp_path / "b")), Scripted(spark), {}, RunConfig(judge=failing()))
    assert run.run(questions.filter("id = 'c'")).stopped == "error" and run.records().first().error.startswith("judge: RuntimeError")


def test_responses_name_their_stages(spark, questions):
    engine = Engine(spark).ingest(spark.createDataFrame(TEXTS, "source_doc string, text string"))
    results, after = engine.run(questions.filter("id <> 'c'").selectExpr("id AS qid", "question"))
    out = {r.qid: [s.stage for s in r.stages] for r in after.responses(results).collect()}
    assert out["a"][0] == "input_guardrail" and out["a"][-2:] == ["generation", "verification"] and "rerank" in out["a"]
    spent = {r.stage: r for r in usage(after.calls).collect()}
    assert spent["generation"].calls == 2 and all(r.failures == 0 and r.retries == 0 for r in spent.values())
