"""Conversation and session state in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int = 3, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The n latest turns of each session, with their age from 1."""
    latest = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("age", F.row_number().over(latest)).filter(F.col("age") <= n)


def live_sessions(events: DataFrame, idle_seconds: float, most: int, session: str = "user_id", ts: str = "ts") -> DataFrame:
    """session, last_used, status: 'expired' at or beyond the idle time before the latest event, 'evicted' beyond the ``most`` most recent, else 'live'."""
    used = events.groupBy(session).agg(F.max(ts).alias("last_used"))
    now = events.agg(F.max(ts).alias("now"))
    rows = used.join(F.broadcast(now))  # one row
    expired = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp")) >= int(idle_seconds * 1_000_000)
    rows = rows.withColumn("expired", expired)
    keep = rows.filter("NOT expired").orderBy(F.desc("last_used"), session).limit(most).select(session, F.lit(True).alias("live"))
    out = rows.join(keep, session, "left")
    return out.select(session, "last_used", F.when(F.col("expired"), "expired").when(F.col("live"), "live").otherwise("evicted").alias("status"))


def sweep(scopes: DataFrame, now: float, ttl_seconds: float) -> DataFrame:
    """Scopes that stay: updated at or after the cutoff (epoch seconds)."""
    return scopes.filter(F.col("updated_at") >= now - ttl_seconds)
