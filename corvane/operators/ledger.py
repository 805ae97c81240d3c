"""Usage, cost and stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_by_stage(calls: DataFrame) -> DataFrame:
    """Tokens and calls by stage with a grand total (stage null becomes 'total')."""
    out = calls.rollup("stage").agg(F.grouping("stage").alias("g"), F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("stage")).alias("stage"), "calls", "prompt_tokens", "output_tokens", (F.col("prompt_tokens") + F.col("output_tokens")).alias("total_tokens"))


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """By model: calls, cost in USD (null when any call is unpriced) and whether one is.

    Prices have model, input and output (per million tokens) or per_call.
    """
    rows = calls.join(prices, "model", "left")
    usd = call_cost()
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(usd), 6).alias("usd"), F.bool_or(usd.isNull()).alias("any_unpriced"))


def latest_stages(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest status and first position of each (keys) by seq."""
    return events.groupBy(*keys).agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("events"))


def call_cost() -> Column:
    """USD of a call joined with its price, null where that is not known."""
    return F.coalesce("per_call", (F.col("prompt_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1_000_000)


def usage_panel(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """By stage: models in order, tokens, calls, the cost of the priced calls, and whether one has no price."""
    usd = call_cost()
    rows = calls.join(prices, "model", "left")
    return rows.groupBy("stage").agg(F.array_sort(F.collect_set("model")).alias("models"), F.sum("prompt_tokens").alias("prompt"), F.sum("output_tokens").alias("output"), F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.coalesce(usd, F.lit(0.0))), 6).alias("cost"), F.bool_or(usd.isNull()).alias("unpriced"))


def append(rows: DataFrame, path: str) -> None:
    """Calls or events at the end of a ledger that only grows."""
    rows.write.mode("append").parquet(path)
