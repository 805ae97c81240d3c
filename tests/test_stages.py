"""Provider calls: isolation, retries, deadlines, key rotation, tolerant replies, and the engine's fallbacks one by one."""

import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_plans import TEXTS, ask

from corvane.functions.text import first_json
from corvane.operators import answering, citations
from corvane.plans.engine import Engine, twice
from corvane.plans.providers import KeyRotator
from corvane.plans.stages import Callers, CallPolicy, Reply, called, isolated


def failing():
    def broken(*args):
        raise RuntimeError("503 overloaded")

    return broken


broken = failing()  # sent to workers by value, which do not know this module


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark).ingest(spark.createDataFrame(TEXTS, "source_doc string, text string"))


def test_one_failure_is_one_row(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(8)], "id long, t string").repartition(2)
    out = {r.id: r.c for r in rows.select("id", called(lambda t: Reply(t.upper(), 5, 1), "string", "t").alias("c")).collect()}
    assert [out[i].value for i in range(8)] == [None if i == 3 else f"T{i}" for i in range(8)]
    assert "AttributeError" in out[3].error and out[3].attempts == 1 and out[0].error is None and (out[0].prompt_tokens, out[0].output_tokens) == (5, 1)
    lists = rows.select(called(lambda t: [1.5, 2.0], "array<double>", "t")["value"].alias("v")).collect()
    assert all(r.v == [1.5, 2.0] for r in lists)
    assert rows.filter("false").select(called(broken, "string", "t").alias("c")).collect() == []


def test_retries_keys_and_deadlines():
    waits, now = [], [0.0]
    clock = lambda: now[0]
    sleep = lambda s: (waits.append(s), now.__setitem__(0, now[0] + s))
    tries = iter([RuntimeError("a"), RuntimeError("b")])

    def flaky(x):
        for e in tries:
            raise e
        return x

    out = isolated(flaky, ("v",), CallPolicy(waits=(1.0, 2.0, 4.0)), sleep=sleep, clock=clock)
    assert (out["value"], out["attempts"], waits) == ("v", 3, [1.0, 2.0])
    late = isolated(broken, (), CallPolicy(waits=(1.0, 50.0), deadline=10.0), sleep=sleep, clock=clock)
    assert late["attempts"] == 2 and late["error"].startswith("RuntimeError")
    assert isolated(broken, (), CallPolicy(waits=(1.0,), transient=lambda e: False), sleep=sleep, clock=clock)["attempts"] == 1
    used = []

    def keyed(x, key):
        used.append(key)
        if key == "k1":
            raise RuntimeError("429")
        return key

    policy = CallPolicy(keys=("k1", "k2"), refused=lambda e: 60.0 if "429" in str(e) else None)
    assert isolated(keyed, (1,), policy, KeyRotator(["k1", "k2"]))["value"] == "k2" and used == ["k1", "k2"]
    both = isolated(lambda x, key: broken(), (1,), CallPolicy(waits=(0.0,), refused=lambda e: 60.0), KeyRotator(["k1"]))
    assert both["error"].startswith("AllKeysBlocked")


def test_calls_run_side_by_side_and_a_hanging_one_is_given_up():
    gate = threading.Barrier(4, timeout=20)
    callers = Callers(lambda x: gate.wait() is not None and x, CallPolicy(concurrency=4), "")
    assert [r["value"] for r in callers.run([(i,) for i in range(4)])] == [0, 1, 2, 3]  # a barrier of four: all at once
    callers.close()
    stop = threading.Event()
    callers = Callers(lambda x: stop.wait(30) if x == 1 else x, CallPolicy(concurrency=1, deadline=0.3), "")
    began = time.monotonic()
    out = callers.run([(0,), (1,), (2,)])
    assert [r["value"] for r in out] == [0, None, 2] and "DeadlineExceeded" in out[1]["error"] and time.monotonic() - began < 10
    stop.set()
    callers.close()


REPLY = '{"safe": false, "verdict": "partial", "missing": "x", "safety": {"verdict": "pass"}, "claims": [{"index": 0, "supported": true}]}'


@pytest.mark.parametrize("shape", ["{}", "```json\n{}\n```", "```\n{}```", "Sure: {}", "By [1] and {{this}}:\n{} (see {{2}}) thanks", "  \n{}\n\n"])
def test_replies_are_read_however_they_are_wrapped(spark, shape):
    rows = spark.createDataFrame([(1, shape.format(REPLY)), (2, "none"), (3, None), (4, "{broken"), (5, "[]")], "qid long, reply string")
    out = {r.qid: r for r in rows.select("qid", answering.unsafe_input(F.col("reply")).alias("u"), answering.safety(F.col("reply")).alias("s"), answering.parse_verdict(F.col("reply")).alias("v"), first_json(F.col("reply")).alias("j")).collect()}
    assert out[1].u and out[1].s == "pass" and (out[1].v.verdict, out[1].v.missing) == ("partial", "x")
    assert all(not out[i].u and out[i].s is None and out[i].v.verdict is None and out[i].j is None for i in (2, 3, 4, 5))
    assert [(r.qid, r.claim, r.supported) for r in citations.verdicts(rows).collect()] == [(1, 0, True)]


def test_a_verifier_is_asked_twice():
    replies = iter(["no json", REPLY, "never"])
    assert twice(lambda: next(replies)) == REPLY and next(replies) == "never"
    replies = iter([None, "again none", "never"])
    assert twice(lambda: next(replies)) == "again none"


def test_every_provider_may_fail(spark, engine):
    """All optional steps fail at once, for one of two questions: it is answered by what is left, the other as if nothing were wrong."""
    fail = lambda real: lambda q, *rest: broken() if "rent" in q else real(q, *rest)
    p = engine.providers
    bad = replace(p, unsafe=fail(p.unsafe), resolve=fail(p.resolve), decompose=fail(p.decompose), expand=fail(p.expand), verdict=fail(p.verdict), web=fail(p.web), rewrite=fail(p.rewrite), rerank=fail(p.rerank), embed=fail(p.embed))
    turns = spark.createDataFrame([("s", 1, 0.0, "When was the rent due?", "then")], "session_id string, turn long, ts double, resolved_question string, answer_summary string")
    own = Engine(spark, engine.passages, engine.settings, bad, turns=turns)
    out, after = ask(spark, own, ("When is the monthly rent due?", "s"), "Where are dogs allowed?")
    assert out[1].status == "answered" and "rent is due" in out[1].answer and out[2].status == "answered" and "garden" in out[2].answer
    calls = after.calls.collect()
    failed = {c.stage for c in calls if c.error}
    assert {"input_guardrail", "query_history", "query_expansion", "rerank"} <= failed and all("503" in c.error for c in calls if c.error)
    assert all(c.attempts == 1 and c.seconds >= 0 for c in calls if c.stage == "generation") and {c.stage for c in calls if not c.error} >= {"generation", "verification"}


def test_generation_and_verification_fail_closed(spark, engine):
    p = engine.providers
    bad = replace(p, answer=lambda q, t: broken() if "rent" in q else p.answer(q, t), verify=broken)
    out, after = ask(spark, Engine(spark, engine.passages, engine.settings, bad), "When is the monthly rent due?", "Where are dogs allowed?")
    assert out[1].status == "failed" and out[1].answer is None
    assert out[2].groundedness == 0.0 and out[2].status == "fallback" and after.cached.count() == 0


def test_an_off_topic_web_is_noted_and_not_kept(spark, engine):
    pages = lambda q: [{"url": "https://e.org/x", "title": "Other", "content": "zzz yyy xxx"}]
    own = Engine(spark, engine.passages, engine.settings.override(web_relevance=0.9), replace(engine.providers, web=pages, rewrite=lambda q, e: "rules for dogs in town parks"))
    out, after = ask(spark, own, "Where are big dogs allowed in town?")
    assert not out[1].sufficient and out[1].answer.endswith(answering.NO_RELEVANT_WEB) and "web search found nothing relevant" in out[1].not_cached and after.cached.count() == 0
