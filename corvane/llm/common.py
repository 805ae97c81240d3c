"""Helpers shared by the operators: scratch tables, distributed ranks, skew-safe joins."""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Left rows of one key that one task of a skew-safe join gets: this many, or total/HOT_KEYS where that is less or total/MOST_HOT where that is more.
TASK_ROWS = 100_000
HOT_KEYS = 1_024
MOST_HOT = 1 << 18
#: Rows that one cell of a distributed prefix sum aims at, and how many cells there are of few rows.
CELL_ROWS = 20_000
CELLS = 1_024
_OWN: dict[str, str] = {}
_RUN: contextvars.ContextVar[str] = contextvars.ContextVar("corvane_run", default="")
_LAST: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run in this machine's JVM."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="corvane-")
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def scratch_run(spark: SparkSession, owner: str) -> Iterator[str]:
    """A folder of its own for the scratch tables written inside; the folder of the owner's previous run is deleted first.

    For callers whose previous result is stored elsewhere by then.  Tables of
    other owners and of no owner stay as they are.
    """
    if owner in _LAST:
        system, at = _path(spark, _LAST.pop(owner))
        system.delete(at, True)
    name = f"{owner}-{uuid.uuid4().hex}"
    _LAST[owner] = f"{scratch_root(spark)}/corvane/{name}"
    token = _RUN.set(name)
    try:
        yield _LAST[owner]
    finally:
        _RUN.reset(token)


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table in the shared scratch folder and read it back, which cuts the lineage and survives lost executors.

    It is deleted with its run, or when the driver ends.
    """
    spark, run = df.sparkSession, _RUN.get() or "loose"
    path = f"{scratch_root(spark)}/corvane/{run}/{tag}-{uuid.uuid4().hex}"
    system, at = _path(spark, path)
    system.deleteOnExit(at)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cells_for(rows: int) -> int:
    return max(1, math.ceil(rows / CELL_ROWS), min(CELLS, rows // 64))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, cells: int) -> DataFrame:
    """Add ``out``: per key, the sum of ``value`` over all rows before this one, as a long.

    Rows of a key are dealt to ``cells`` cells by a hash of ``order``, ranked
    inside their cell, and shifted by the totals of earlier cells, so no task
    sees a whole key.  The total order is (cell, order).  ``df`` is read twice
    and must be repeatable.
    """
    cell, val, base = "__cell", "__val", "__base"
    df = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")).withColumn(val, value.cast("long"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, cell).agg(F.sum(val).alias("__total"))
    totals = totals.withColumn(base, F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(cell).alias("__kc"), base)
    on = F.col(cell) == F.col("__kc")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, on, "left").drop("__kc", *[f"__k{i}" for i in range(len(keys))])
    return joined.withColumn(out, F.col(base) + F.coalesce(F.sum(val).over(inside), F.lit(0))).drop(cell, val, base)


def hot_limit(total: int) -> int:
    """Left rows of one key beyond which its rows are dealt to several tasks; no more than MOST_HOT keys can have so many."""
    return max(64, min(TASK_ROWS, total // HOT_KEYS), total // MOST_HOT)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, which are unique and non-null on the right; ``rows`` there counts the left rows of each key.

    A key of more than ``hot_limit`` rows is split: its left rows go to as many
    tasks as it needs, by a hash of ``by`` (columns that tell a key's rows
    apart), and its one right row to each of them.  Which keys, and into how
    many parts, is a broadcast of two longs for each of at most MOST_HOT keys.
    ``how``: inner or left.
    """
    limit = hot_limit(total)
    single = len(keys) == 1 and dict(right.dtypes)[keys[0]] == "bigint"
    tag = F.col(keys[0]) if single else F.xxhash64(*keys)
    hot = right.filter(F.col(rows) > limit).select(tag.alias("__tag"), F.ceil(F.col(rows) / limit).cast("int").alias("__parts"))
    if not single:  # two keys may share a hash: both are split alike
        hot = hot.groupBy("__tag").agg(F.max("__parts").alias("__parts"))
    extra = [c for c in right.columns if c not in keys]
    one = right.select(tag.alias("__rtag"), *[F.col(k).alias(f"__r_{k}") for k in keys], F.struct(*extra).alias("__right"))
    one = one.join(F.broadcast(hot), F.col("__rtag") == F.col("__tag"), "left")
    one = one.withColumn("__rpart", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__tag", "__rtag", "__parts")
    many = left.withColumn("__ltag", tag).join(F.broadcast(hot), F.col("__ltag") == F.col("__tag"), "left")
    many = many.withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(17), *by), F.col("__parts")).cast("int")))
    on = F.col("__part") == F.col("__rpart")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    both = many.join(one, on, how)
    return both.select(*left.columns, *[F.col(f"__right.{c}").alias(c) for c in extra])


def stored_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``skew_join`` with a stored ``right``, whose keys are looked at first: where none is split, both sides meet sorted and the driver broadcasts nothing."""
    if (right.agg(F.max(rows)).first()[0] or 0) > hot_limit(total):
        return skew_join(left, right, keys, rows, total, by, how)
    extra = [c for c in right.columns if c not in keys]
    return left.join(right.hint("merge"), keys, how).select(*left.columns, *extra)


def least_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int, out: str, deal: Column, parts: int = 64) -> DataFrame:
    """The ``most`` first rows of each key in ``order``, with their place from 1 in ``out``.

    First of each of ``parts`` dealt shares of a key, then of these, so that no
    task gets more of a key than its share or parts * most rows.
    """
    share = rows.withColumn("__share", F.pmod(deal, F.lit(parts)))
    near = Window.partitionBy(*keys, "__share").orderBy(*order)
    share = share.withColumn(out, F.row_number().over(near)).filter(F.col(out) <= most).drop("__share")
    return share.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= most)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


ROW = "__rid"


def number_rows(docs: DataFrame) -> DataFrame:
    """The rows with a stable number in ``ROW``, written once; a rescan could number them otherwise."""
    return materialize(docs.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def row_id(docs: DataFrame) -> Column:
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
