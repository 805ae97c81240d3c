"""Weighted reciprocal rank fusion over a long table of hits.

Hits have qid, retriever ('vector' or 'keyword'), query, chunk_id, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_lists(hits: DataFrame) -> DataFrame:
    """Best hit per chunk in each list, ranked by score (ties by chunk)."""
    best = hits.groupBy("qid", "retriever", "query", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid", "retriever", "query").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order))


def _dense_lists() -> Column:
    """How many dense lists of the question have hits: they share the dense weight."""
    return F.size(F.collect_set(F.when(F.col("retriever") == "vector", F.coalesce("query", F.lit("")))).over(Window.partitionBy("qid")))


def _part(weight: Column, n_dense: Column, k: int) -> Column:
    return F.when(F.col("retriever") == "vector", weight / n_dense).otherwise(1.0 - weight) / (k + F.col("rank"))


def fuse(hits: DataFrame, dense_weight: float = 0.5, k: int = 60, digits: int = 9) -> DataFrame:
    """qid, chunk_id, fused, provenance, position."""
    parts = ranked_lists(hits).withColumn("part", _part(F.lit(dense_weight), _dense_lists(), k))
    source = F.struct("retriever", "rank", "query", "score")
    out = parts.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), digits).alias("fused"), F.array_sort(F.collect_list(source)).alias("provenance"))
    order = Window.partitionBy("qid").orderBy(F.desc("fused"), "chunk_id")
    return out.filter("fused > 0").withColumn("position", F.row_number().over(order))


def sweep(hits: DataFrame, weights: tuple[float, ...], k: int = 60, digits: int = 9) -> DataFrame:
    """dense_weight, qid, chunk_id, fused, position under each weight; the lists are ranked once."""
    ranked = ranked_lists(hits).withColumn("n_dense", _dense_lists()).withColumn("dense_weight", F.explode(F.array(*map(F.lit, weights))))
    part = _part(F.col("dense_weight"), F.col("n_dense"), k)
    out = ranked.groupBy("dense_weight", "qid", "chunk_id").agg(F.round(F.sum(part), digits).alias("fused"))
    order = Window.partitionBy("dense_weight", "qid").orderBy(F.desc("fused"), "chunk_id")
    return out.filter("fused > 0").withColumn("position", F.row_number().over(order))
