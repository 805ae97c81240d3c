"""Places in one order over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import saved

_INSIDE = (1 << 33) - 1


def placed(rows: DataFrame, order: list[Column | str], out: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order, which tells all rows apart.

    The sorted table is written with each row's partition and number in it;
    the rows of earlier partitions are a sum over one row a partition.
    """
    number = "__number"
    kept = saved(rows.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(number, 33).alias("__part")
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    out_rows = kept.withColumn("__part", F.shiftright(number, 33)).join(F.broadcast(starts), "__part")
    place = (F.col("__start") + F.col(number).bitwiseAND(F.lit(_INSIDE)) + 1).cast("int")
    return out_rows.withColumn(out, place).drop("__part", "__start", number)
