"""Turns with list state and timers on a fed stream."""

import json
import os

from corvane.streaming.sessions import STATE_STORE, history


def test_third_and_fourth_turn_and_expiry(spark, tmp_path):
    """Three turns stay, the fourth evicts the first, and a conversation idle beyond its time is forgotten and begins anew."""
    (tmp_path / "in").mkdir()
    hour = lambda h: f"2024-01-01T{h:02d}:00:00"
    batches = [
        [(1, 1, "a", hour(1)), (1, 2, "b", hour(1)), (2, 1, "x", hour(1))],
        [(1, 3, "c", hour(2))],
        [(1, 4, "d", hour(3))],
        [(3, 1, "later", hour(9))],  # moves the watermark beyond the idle time of the others
        [(3, 2, "more", hour(10))],
        [(1, 5, "again", hour(11))],
    ]
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "text", "ts"), r))) for r in rows))
        stamp = 1_700_000_000 + i
        os.utime(tmp_path / "in" / f"{i}.json", (stamp, stamp))
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    seen = []
    try:
        turns = spark.readStream.schema("conv_id long, turn long, text string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = history(turns, idle_ms=2 * 3_600_000, late="0 seconds")
        query = out.writeStream.foreachBatch(lambda df, n: seen.append(sorted((r.conv_id, tuple(r.kept)) for r in df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    flat = [x for batch in seen for x in batch]
    assert flat[:2] == [(1, ("a", "b")), (2, ("x",))] and (1, ("a", "b", "c")) in flat and (1, ("b", "c", "d")) in flat
    assert (2, ()) in flat and (1, ()) in flat and flat.index((1, ())) < flat.index((1, ("again",)))
