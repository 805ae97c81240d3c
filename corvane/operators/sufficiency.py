"""Is the retrieved context enough?  Scores and gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    # fixed values: at or above the high score passages suffice, below the low one they do not
    high: float = 0.90
    low: float = 0.78


def compute_scores(hits: DataFrame) -> DataFrame:
    """qid, top_dense, mean_top3_dense, top_keyword from hits (qid, chunk_id, retriever, score)."""
    by_chunk = hits.groupBy("qid", "chunk_id").agg(F.max(F.when(F.col("retriever") == "vector", F.col("score"))).alias("dense"), F.max(F.when(F.col("retriever") == "keyword", F.col("score"))).alias("keyword"))
    top = F.slice(F.sort_array(F.collect_list("dense"), asc=False), 1, 3)
    out = by_chunk.groupBy("qid").agg(F.max("dense").alias("top_dense"), top.alias("top3"), F.max("keyword").alias("top_keyword"), F.count(F.lit(1)).alias("candidates"))
    mean = F.when(F.size("top3") > 0, F.aggregate("top3", F.lit(0.0), lambda a, x: a + x) / F.size("top3"))
    return out.withColumn("mean_top3_dense", mean).drop("top3")


def decide(scores: DataFrame, gate: Gate = Gate(), session: Column | None = None, verdict: Column | None = None) -> DataFrame:
    """sufficient, partial, method.  A grey score needs a verdict (sufficient, partial, insufficient); none leans insufficient."""
    session = F.lit(False) if session is None else session
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    top, known = F.col("top_dense"), verdict.isin("sufficient", "partial", "insufficient")
    stage = (
        F.when(F.col("candidates") == 0, "none")
        .when(top >= gate.high, "high")
        .when((top < gate.low) & ~session, "low")
        .when(known, "verdict")
        .otherwise("fallback")
    )
    out = scores.withColumn("stage", stage)
    return out.select(
        *scores.columns,
        ((F.col("stage") == "high") | ((F.col("stage") == "verdict") & (verdict == "sufficient"))).alias("sufficient"),
        F.coalesce((F.col("stage") == "verdict") & (verdict == "partial"), F.lit(False)).alias("partial"),
        F.when(F.col("stage").isin("none", "high", "low"), "score").when(F.col("stage") == "verdict", "llm").otherwise("fallback").alias("method"),
    )
