"""The approximate vector index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.operators import dense, vectors
from corvane.operators.vectors import IvfConfig


def asked(frame):
    return frame.filter("embedding IS NOT NULL").filter("pmod(vec_id, 20) = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in middles[i % 12] + 0.15 * rng.standard_normal(16)]) for i in range(600)]
    return spark.createDataFrame([*rows, (600, rows[0][1]), (601, rows[0][1]), (602, None), (603, [0.0] * 16)], "vec_id long, embedding array<double>")


def test_recall_on_clustered_vectors_with_few_probes(clustered, tmp_path):
    index = vectors.build(clustered, str(tmp_path / "i"))
    assert index.lists().count() == 603 and len(index.centroids) == 24
    got = vectors.recall(index, clustered, asked(clustered), k=10, probes=6)
    assert got.agg(F.avg("recall")).first()[0] >= 0.9
    few = vectors.probes_for(index, clustered, k=10)
    assert few < len(index.centroids)


def test_all_lists_are_exact_and_hot_lists_are_split(clustered, tmp_path):
    index = vectors.build(clustered, str(tmp_path / "i"), config=IvfConfig(most_lists=3, list_rows=40))
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.score)
    got = sorted(map(key, index.top_k(asked(clustered), 7, probes=3).collect()))
    assert got == sorted(map(key, dense.cosine_top_k(clustered, asked(clustered), 7).collect()))


def test_batches_add_to_the_lists(clustered, tmp_path):
    index = vectors.build(clustered.filter("vec_id < 300"), str(tmp_path / "i"))
    index.add(clustered.filter("vec_id >= 300"))
    assert index.lists().select("key").distinct().count() == 603
    got = vectors.recall(index, clustered, asked(clustered), k=10, probes=len(index.centroids)).agg(F.min("recall")).first()[0]
    assert got == 1.0


def test_no_vectors(spark, clustered, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        vectors.build(clustered.filter("embedding IS NULL"), str(tmp_path / "i"))
    index = vectors.build(clustered, str(tmp_path / "j"))
    assert index.top_k(asked(clustered).limit(0)).collect() == []


def test_query_has_the_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in dense.cosine_top_k(table, asked(table)).collect()}
    found = {(r.query_id, r.vec_id) for r in queries.q_ivf_topk(spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_keys_of_other_types(spark, clustered):
    other = clustered.select(F.col("vec_id").cast("double").alias("vec_id"), "embedding")
    assert len(dense.cosine_top_k(other, asked(other), 2).collect()) == 2 * asked(other).count()
