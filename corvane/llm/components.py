"""Connected components by alternating large-star and small-star steps.

Every step is a map-side-combined minimum or a skew-safe join, and is stored
before the next one: a whole round in one plan has tens of exchanges and
broadcasts, all of which the driver plans anew as each of them ends and holds
at once.  Nothing but four numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, stored_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs); root is the least node of its component."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    state = None
    while True:
        total, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not total or (total, mark) == state:
            break
        state = (total, mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        large = stored_join(both, least, ["u"], "n", 2 * total, ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
        small = stored_join(large, low, ["u"], "n", 2 * total, ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc-edges")
    # at the fixed point every node hangs on its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
