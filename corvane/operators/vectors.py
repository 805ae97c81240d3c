"""An approximate vector index: inverted lists under centroids, stored, with the exact scan beside it.

Centroids are fitted on a bounded sample, the vectors with the least hashes of
their keys; every vector is in the list of its nearest centroid, in files of
that list.  A query reads the lists of its nearest ``probes`` centroids alone
and ranks what is there by the exact cosine.  Lists grow with the table, so the
number of centroids does, up to a bound; a list that is longer than a task
should read is in several files, dealt by key, and each task keeps only the k
best of a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.dense import cosine_top_k
from corvane.sources.tables import saved
from corvane.sources.versions import VersionedTable

#: Query rows that one task of a list holds at a time.
QUERY_ROWS = 8_192


@dataclass(frozen=True)
class IvfConfig:
    sample: int = 65_536  # vectors that centroids are fitted on, at most
    most_lists: int = 4_096  # centroids; sent to every task, so bounded
    list_rows: int = 50_000  # vectors of one file of a list
    rounds: int = 12
    digits: int = 6
    seed: int = 11


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def lists_for(n: int, config: IvfConfig) -> int:
    return max(1, min(config.most_lists, math.isqrt(n)))


def fit_centroids(x: np.ndarray, lists: int, config: IvfConfig) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors; a list left empty takes the vector that is worst placed."""
    rng = np.random.default_rng(config.seed)
    lists = min(lists, len(x))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(config.rounds):
        score = x @ centroids.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(score.max(axis=1))[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _placed(centroids: np.ndarray, probes: int):
    """The numbers of the nearest centroids of each vector, the nearest first."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors):
                score = unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors])) @ centroids.T
                yield pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)))
            else:
                yield pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<int>")


@dataclass(frozen=True)
class IvfIndex:
    store: VersionedTable
    centroids: np.ndarray
    key: str
    config: IvfConfig

    def lists(self) -> DataFrame:
        """list, key, vector of every vector that is indexed."""
        rows = self.store.table()
        assert rows is not None
        return rows

    def add(self, vectors: DataFrame, vector: str = "embedding") -> IvfIndex:
        """With more vectors, in new files under the same centroids."""
        rows = vectors.select(F.col(self.key).alias("key"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
        rows = rows.withColumn("list", F.get(_placed(self.centroids, 1)("vector"), F.lit(0)))
        files = max(1, math.ceil(rows.count() / len(self.centroids) / self.config.list_rows))
        dealt = rows.repartition(min(2_048, len(self.centroids) * files), "list", F.pmod(F.xxhash64("key"), F.lit(files)))
        state = self.store.manifest()
        part = self.store.write_part(dealt.sortWithinPartitions("list"), ("list",))
        self.store.commit(state["version"], [*state["parts"], part], state["info"])
        return self

    def top_k(self, queries: DataFrame, k: int = 20, probes: int = 8, query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """query_key, key, score, rank: the k best of the nearest ``probes`` lists of each query; ties by key."""
        asked = queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("asked")).filter(F.col("asked").isNotNull())
        asked = asked.withColumn("list", F.explode(_placed(self.centroids, min(probes, len(self.centroids)))("asked")))
        held = self.lists()
        kinds = dict(asked.dtypes)["query"], dict(held.dtypes)["key"]
        arrow = to_arrow_type(asked.schema["query"].dataType), to_arrow_type(held.schema["key"].dataType)
        digits = self.config.digits

        def rank(groups_left: Iterator[pa.RecordBatch], groups_right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One (list, part) of vectors against the queries that probe it, in blocks of either."""
            wanted = [b for b in groups_right if b.num_rows]
            ids = [q for b in wanted for q in b.column("query").to_pylist()]
            asked_rows = unit(np.stack([np.asarray(v, dtype=np.float64) for b in wanted for v in b.column("asked").to_pylist()])) if ids else None
            best: dict[int, list[tuple[float, object]]] = {}
            for batch in groups_left:
                if not ids or not batch.num_rows:
                    continue
                keys = batch.column("key").to_pylist()
                matrix = unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch.column("vector").to_pylist()]))
                for at in range(0, len(ids), QUERY_ROWS):
                    score = np.round(asked_rows[at : at + QUERY_ROWS] @ matrix.T, digits)
                    for i, row in enumerate(score, at):
                        order = np.argsort(-row, kind="stable")
                        cut = row[order[min(k, len(order)) - 1]]
                        own = best.get(i, []) + [(-float(row[j]), keys[j]) for j in order[: int((row >= cut).sum())]]
                        best[i] = sorted(own)[:k]
            rows = [(ids[i], name, -s) for i, found in best.items() for s, name in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow[0]), pa.array([r[1] for r in rows], arrow[1]), pa.array([r[2] for r in rows], pa.float64())], ["query", "key", "score"])

        parts = max(1, math.ceil(held.count() / len(self.centroids) / self.config.list_rows))
        left = held.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi")  # most_lists numbers at most: other lists' files are not read
        left = left.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        hits = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(rank_tables(rank), f"query {kinds[0]}, key {kinds[1]}, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        out = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return out.select(F.col("query").alias(query_key), F.col("key").alias(self.key), "score", "rank")


def rank_tables(rank):
    """``rank`` as a function of two Arrow tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(rank(iter(left.to_batches(max_chunksize=4_096)), iter(right.to_batches()))))

    return run


def build(vectors: DataFrame, root: str, key: str = "vec_id", vector: str = "embedding", config: IvfConfig = IvfConfig()) -> IvfIndex:
    """The index of all vectors, its centroids fitted on at most ``sample`` of them."""
    rows = vectors.filter(F.col(vector).isNotNull())
    n = rows.count()
    picked = rows.select(vector).orderBy(F.xxhash64(key), key).limit(config.sample).collect() if n > 0 else []
    if not picked:
        raise ValueError("no vectors to index")
    centroids = fit_centroids(unit(np.array([r[0] for r in picked], dtype=np.float64)), lists_for(n, config), config)
    return IvfIndex(VersionedTable(vectors.sparkSession, root), centroids, key, config).add(vectors, vector)


def recall(index: IvfIndex, vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = 8, vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """query_key, recall: of each query the share of its exact k best that the index finds, equal scores counting as equal."""
    exact = cosine_top_k(vectors, queries, k, key=index.key, vector=vector, query_key=query_key)
    worst = exact.groupBy(query_key).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    found = index.top_k(queries, k, probes, query_key).join(worst, query_key).filter(F.col("score") >= F.col("least"))
    good = found.groupBy(query_key).agg(F.count(F.lit(1)).alias("good"))
    return worst.join(good, query_key, "left").select(query_key, (F.coalesce("good", F.lit(0)) / F.col("n")).alias("recall"))


def probes_for(index: IvfIndex, vectors: DataFrame, k: int = 20, target: float = 0.9, sample: int = 64, vector: str = "embedding") -> int:
    """The least of 4, 8, 16, ... lists, or all, whose mean recall over ``sample`` vectors of the table, taken by the hash of their keys, is the target.

    How many that is depends on how clustered the vectors are; for vectors
    without clusters it is most of the lists.
    """
    asked = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(1), index.key), index.key).limit(sample)
    asked = saved(asked.select(F.col(index.key).alias("query_id"), F.col(vector).alias("query_vector")), "probe-sample")
    probes = 4
    while probes < len(index.centroids) and (recall(index, vectors, asked, k, probes, vector).agg(F.avg("recall")).first()[0] or 0.0) < target:
        probes *= 2
    return min(probes, len(index.centroids))
