"""Vector retrieval: exact cosine top-k in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries whose vectors one pass over the passages holds; more queries are further passes.
QUERY_BLOCK = 4_096
#: Cells of the score matrix that a task holds at once.
CELLS = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def _matrix(vectors: list) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector", digits: int = 6, scope: str | None = None) -> DataFrame:
    """query_key, key, score, rank: exact, ties by key.  Each task sends k candidates per query at most.

    With ``scope``, a column of both sides, a query meets the vectors of its
    own scope alone (null meets null).  Keys are of any type that sorts.
    """
    names = [query_key, query_vector, *([scope] if scope else [])]
    asked = queries.select(names).filter(F.col(query_vector).isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    arrow = to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(vectors.schema[key].dataType)
    found = []
    for block in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == block)
        rows = own.collect()  # about QUERY_BLOCK vectors
        ids = [r[query_key] for r in rows]
        matrix = _matrix([r[query_vector] for r in rows]) if rows else np.zeros((0, 1))
        scopes = np.array([r[scope] for r in rows], dtype=object) if scope else None

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, scopes=scopes) -> Iterator[pa.RecordBatch]:
            best = np.full((0, len(ids)), -np.inf)  # rows: candidates of each query, the best first
            names = np.empty((0, len(ids)), dtype=object)
            for batch in batches:
                for at in range(0, batch.num_rows if ids else 0, max(1, CELLS // max(1, len(ids)))):
                    part = batch.slice(at, max(1, CELLS // max(1, len(ids))))
                    keys = np.array(part.column(0).to_pylist())
                    score = np.round(_matrix(part.column(1).to_pylist()) @ matrix.T, digits)
                    if scopes is not None:
                        score[np.array(part.column(2).to_pylist(), dtype=object)[:, None] != scopes[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(keys[:, None], score.shape), -score), axis=0)[:k]
                    both = np.concatenate([best, np.take_along_axis(score, order, 0)])
                    both_names = np.concatenate([names, keys[order].astype(object)])
                    place = np.array(both_names.tolist()).reshape(both.shape) if both.size else both_names
                    order = np.lexsort((place, -both), axis=0)[:k]
                    best, names = np.take_along_axis(both, order, 0), np.take_along_axis(both_names, order, 0)
            q, at = np.nonzero(best.T > -np.inf)
            out = pd.DataFrame({query_key: [ids[i] for i in q.tolist()], key: names.T[q, at], "score": best.T[q, at]})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        columns = [key, vector, *([scope] if scope else [])]
        found.append(vectors.select(columns).filter(F.col(vector).isNotNull()).mapInArrow(_typed(run, *arrow, query_key, key), f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _typed(run, query_kind: pa.DataType, key_kind: pa.DataType, query_key: str, key: str):
    schema = pa.schema([(query_key, query_kind), (key, key_kind), ("score", pa.float64())])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(f.type) if batch.num_rows else pa.array([], f.type) for i, f in enumerate(schema)], schema=schema)

    return cast


def label_vote(hits: DataFrame, labels: DataFrame, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """Majority label of each query's hits; ties by label."""
    counted = hits.join(labels, key).groupBy(query_key, "label").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy(query_key).orderBy(F.desc("votes"), "label")
    return counted.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
