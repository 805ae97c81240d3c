"""Streams of conversation turns and usage events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def usage_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Calls and value per event type and window; state older than the watermark is dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))


def last_turns(turns: DataFrame, n: int = 3, idle_ms: int = 24 * 3_600_000) -> DataFrame:
    """conv_id, kept: the n latest turn texts of each conversation, after every batch that touches it; idle state is dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for rows in batches:
            kept += list(zip((int(t) for t in rows["turn"]), rows["text"], strict=True))
        kept = sorted(kept)[-n:]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [[x for _, x in kept]]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, kept array<string>", "turns array<long>, texts array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


class TurnHistory(StatefulProcessor):
    """The n latest turns of a conversation as list state; a timer ends it when it has been idle for so long in event time."""

    def __init__(self, n: int, idle_ms: int) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, text string, ts long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        kept = [(int(t), x, int(ms)) for t, x, ms in self.turns.get()] if self.turns.exists() else []
        for batch in rows:
            kept += zip((int(t) for t in batch["turn"]), batch["text"], (int(x.timestamp() * 1000) for x in batch["ts"]), strict=True)
        latest = max(ms for _, _, ms in kept)
        kept = sorted(kept)[-self.n :]
        self.turns.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [[x for _, x, _ in kept]]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [[]]})

    def close(self) -> None:
        pass


#: The state store that list state and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def history(turns: DataFrame, n: int = 3, idle_ms: int = 24 * 3_600_000, late: str = "10 minutes") -> DataFrame:
    """conv_id, kept: of a stream of turns (conv_id, turn, text, ts) the n latest texts after every batch that touches a conversation, none when it has expired.

    The session needs the settings ``STATE_STORE``.
    """
    rows = turns.withWatermark("ts", late).groupBy("conv_id")
    return rows.transformWithStateInPandas(TurnHistory(n, idle_ms), "conv_id long, kept array<string>", "update", "EventTime")
