"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from corvane.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, v int, d int, n int"


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24)) * 0.75 ** np.arange(24) * 8
    rows = [(i if i != 5 else None, [float(x) for x in v], 0, "c", 1, 2, 3) for i, v in enumerate(base)]
    bad = [None, [], [None] * 24, [float("nan")] + [0.0] * 23, [math.inf] * 24, [1.0] * 7, [1.0] * 23 + [None]]
    return rows + [(1000 + i, b, 0, "c", 1, 2, 3) for i, b in enumerate(bad)] + [rows[0]] * 40 + [rows[7]]


def dense(rows, d):
    good = [(k, v) for k, v, *_ in rows if v and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (fit * n - s) / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    return good, x, n, s, value[::-1], vector[:, ::-1]


def compare(out, rows, d, k):
    good, x, n, s, value, vector = dense(rows, d)
    assert len(out) == len(good) * k
    white = (x * n - s) / n @ vector[:, :k] / np.sqrt(value[:k])
    dev = [int(sum(int(a) ** 2 for a in row)) for row in x * n - s]
    want = sorted((str(key), c + 1, dev[i], abs(white[i, c])) for i, (key, _) in enumerate(good) for c in range(k))
    got = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-8)
    share = {r.component: r.explained for r in out}
    assert np.allclose([share[c + 1] for c in range(k)], value[:k] / value.sum(), rtol=1e-10)
    assert {r.n for r in out} == {n} and all(r.identity_error < 1e-10 for r in out)


def test_awkward_rows_equal_a_dense_solution(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compare(whitening.components(frame).collect(), rows, 24, 16)


@pytest.mark.parametrize("block, kept", [(8, 2), (4, 3)])
def test_small_blocks_iterate_to_the_same_components(spark, block, kept):
    rows = vectors()
    config = whitening.WhitenConfig(components=4, block=block, kept=kept)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    _, model = whitening.fit(frame, config)
    assert model.passes > 2 and model.residual <= config.tolerance
    compare(whitening.components(frame, config).collect(), rows, 24, 4)


def test_query_on_the_smallest_table(spark, sf):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op12_whitening(spark, sf).collect(), rows, 64, 16)


def test_empty_constant_and_thin_tables(spark):
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<float>")
    assert whitening.components(make([])).collect() == [] and whitening.components(make([None, []])).collect() == []
    assert whitening.components(make([[1.0, 2.0]] * 3)).collect() == []
    out = whitening.components(make([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).collect()
    assert {r.component for r in out} == {1} and len(out) == 3 and abs(out[0].explained - 1) < 1e-12


def test_overflow_is_an_error(spark):
    rows = spark.createDataFrame([(i, [float(10.0**14 * i)]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.components(rows).collect()
