"""Files that a dying writer leaves, and deletions with counts."""

import os

import pytest
from test_plans import TEXTS

from corvane.plans.engine import Engine
from corvane.sources import files


def test_a_dead_writer_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    read = lambda: sorted(r.id for r in spark.read.json(path).collect())
    files.write_json_atomic(spark, spark.range(2), path)
    files.write_json_atomic(spark, spark.range(3), path)
    assert read() == [0, 1, 2] and os.listdir(tmp_path) == ["state"]
    os.rename(path, path + ".old")  # the writer died after renaming the old version aside
    files.recover_json(spark, path)
    assert read() == [0, 1, 2]
    os.rename(path, path + ".old")
    files.write_json_atomic(spark, spark.range(4), path)  # the next writer goes on from either state
    assert read() == [0, 1, 2, 3] and os.listdir(tmp_path) == ["state"]


def test_deletion_says_what_went(spark):
    engine = Engine(spark).ingest(spark.createDataFrame(TEXTS, "source_doc string, text string"))
    after, counts = engine.remove("dogs.txt")
    assert counts == {"deleted_chunks": 1, "invalidated_cache_entries": 0} and after.passages.count() == 1
    with pytest.raises(LookupError):
        after.remove("dogs.txt")
    index = engine.index  # built, then changed by the deletion
    assert index.n_docs == 2 and engine.delete("dogs.txt").index.n_docs == 1
