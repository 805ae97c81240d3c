"""What the near-duplicate search asks of the driver."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import components, simhash
from corvane.llm.common import ROW


def test_a_round_of_components_is_stored_step_by_step(spark, monkeypatch):
    plans = []
    stored = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, *a))
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert len(plans) > 8 and all(p.count("Join") <= 1 and "broadcast" not in p for p in plans)


def test_hubs_are_dealt(spark, monkeypatch):
    split = []
    plain = components.stored_join
    monkeypatch.setattr(components, "stored_join", lambda *a: split.append(out := plain(*a)) or out)
    hub = [(0, i) for i in range(1, 400)] + [(399, 1000), (1001, 1000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(400), 1000, 1001]}
    assert any("broadcast" in x._jdf.queryExecution().optimizedPlan().toString() for x in split)  # over 64 rows of a key here: its parts are broadcast


def test_a_plan_takes_little_memory():
    bits = np.random.default_rng(3).integers(0, 2, (simhash.SAMPLE, 128), dtype=np.uint8)
    bits[:, 7], bits[:, 99] = 1, bits[:, 3]
    tracemalloc.start()
    layout = simhash.plan_index(bits, 50_000, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6
    assert sorted(b for p in layout.parts for b in p) == list(range(128)) and sum(t + 1 for t in layout.thresholds) == 11
    assert any({3, 99} <= {*p} for p in layout.parts)  # equal bits share a part


def test_a_sample_is_chosen_by_hash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    words = spark.range(0, 4_000, 1, 8).select(F.xxhash64("id").alias("w0"), F.xxhash64("id", F.lit(1)).alias("w1"))
    few = simhash._sample(words, 4_000)
    assert 120 < len(few) < 300 and few.shape[1] == 128
    every = [(r.w0, r.w1) for r in words.limit(50).collect()]
    got = simhash._sample(spark.createDataFrame(every, "w0 long, w1 long"), 50)
    assert sorted(map(tuple, got.tolist())) == sorted(tuple(map(int, f"{a & (2**64 - 1):064b}{b & (2**64 - 1):064b}")) for a, b in every)


def test_first_rows_are_those_of_the_groups(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(rng.choice([None, i, i // 3]), " ".join(f"{base[i % 40]:x}{k}" for k in range(30 + i % 2))) for i in range(200)]
    docs = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(rows)], f"doc_id long, text string, {ROW} long")
    config = simhash.SimHashConfig(shingle=1, radius=10, words64=2, distinct=True)
    best = {}
    for r in simhash.near_duplicates(docs, config).collect():
        best[r.root] = min(best.get(r.root, (True, 1 << 60, 1 << 60)), (r.doc_id is None, r.doc_id or 0, r.rid))
    assert sorted(r.rid for r in simhash.first_rows(docs, config).collect()) == sorted(b[2] for b in best.values()) and len(best) < 200
