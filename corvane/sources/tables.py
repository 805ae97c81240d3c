"""Tables written between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple, tuple[str, Any]] = {}


def table_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run in this machine's JVM."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="corvane-tables-")
    return _OWN[app]


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def saved(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The same rows, written once and read back: later steps neither recompute nor replan them.  Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{table_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(table: DataFrame, name: str, build: Callable[[DataFrame], Any]) -> Any:
    """What ``build`` made of a table of files, from the last call in this application if neither its files nor the scratch folder have changed since."""
    spark, sign = table.sparkSession, []
    for file in sorted(table.inputFiles()):
        system, at = file_system(spark, file)
        status = system.getFileStatus(at)
        sign.append((file, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(sign))
    if key in _KEPT:
        marker, made = _KEPT[key]
        system, at = file_system(spark, marker)
        if system.exists(at):
            return made
    made = build(table)
    marker = f"{table_root(spark)}/tables/{name}-{uuid.uuid4().hex}.kept"
    system, at = file_system(spark, marker)
    system.create(at, True).close()
    system.deleteOnExit(at)
    _KEPT[key] = (marker, made)
    return made
