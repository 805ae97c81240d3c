"""From ranked candidates to the passages of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import alike, word_set, words

# fixed value: the percentage of common words from which two passages are one
NEAR_DUPLICATE = 90


def rerank_pool(candidates: DataFrame, most_web: int = 5, most: int = 20) -> DataFrame:
    """Web candidates first, at most ``most_web``, then corpus ones up to ``most`` in all; pool_position is 1-based.

    Candidates have qid, chunk_id, source ('corpus' or 'web') and position.
    """
    within = Window.partitionBy("qid", "source").orderBy("position", "chunk_id")
    rows = candidates.withColumn("n", F.row_number().over(within)).filter((F.col("source") != "web") | (F.col("n") <= most_web))
    order = Window.partitionBy("qid").orderBy((F.col("source") != "web").cast("int"), "n")
    return rows.withColumn("pool_position", F.row_number().over(order)).filter(F.col("pool_position") <= most).drop("n")


def token_count(text: Column) -> Column:
    """Default length function: white-space words."""
    return F.size(words(text))


def consolidate(ranked: DataFrame, top_k: int = 8, budget: int = 3_000) -> DataFrame:
    """qid, chunk_id, tokens, used for the kept candidates, in rank order.

    Stops at top_k; skips near duplicates of kept ones and candidates beyond
    the budget, after which smaller ones may still fit.  One fold per question
    over its shortlist, which is bounded by the pool.
    """
    item = F.struct("position", "chunk_id", token_count(F.col("text")).alias("tokens"), word_set(F.col("text")).alias("w"))
    lists = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.filter("items", lambda x: F.lit(False))
    start = F.struct(empty.alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc["kept"], lambda y: alike(x["w"], y["w"], NEAR_DUPLICATE))
        take = (F.size(acc["kept"]) < top_k) & ~near & (acc["used"] + x["tokens"] <= budget)
        return F.when(take, F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["used"] + x["tokens"]).alias("used"))).otherwise(acc)

    out = lists.select("qid", F.aggregate("items", start, step).alias("r"))
    out = out.select("qid", F.col("r.used").alias("used"), F.posexplode("r.kept").alias("i", "x"))
    return out.select("qid", (F.col("i") + 1).alias("passage"), "x.chunk_id", "x.tokens", "used")


def number_passages(rows: DataFrame) -> DataFrame:
    """Global passage numbers by first appearance over (list_no, position) of each chunk."""
    first = rows.groupBy("qid", "chunk_id").agg(F.min(F.struct("list_no", "position")).alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk_id"))).drop("at")


def union_contexts(main: DataFrame, others: DataFrame) -> DataFrame:
    """Main and sub-question contexts; of a chunk's rows the first stays (list_no, position)."""
    both = main.unionByName(others, allowMissingColumns=True)
    order = Window.partitionBy("qid", "chunk_id").orderBy("list_no", "position")
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
