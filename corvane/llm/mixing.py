"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of its documents.  Its quota, in
words, is a number of whole passes over the source plus a part of one more
pass.  The quotas, counted in block draws, are split among the output shards
by a binary tree: at each node the left half's draws of every source follow a
multivariate hypergeometric distribution, so the shards' counts are those of a
perfect shuffle and add up exactly.  A shard takes disjoint ranges of each
source's permuted blocks and orders their documents by a seeded hash
(``order_key``; ``shuffled`` lays the rows out so).

The part of a pass takes permuted blocks while they fit, then documents of the
block at the boundary, in a seeded order, while they fit (a prefix sum).  What
is then still open is filled from all documents of the source that are not
taken, the largest sizes first, as many of a size as there are and fit, until
none fits; last one more of the least size, where that comes nearer.  So a
source's words differ from its target by at most half the least size that is
left.  Sizes are counted, and equal rows are counted before they are ranked, so
that neither a common size nor a document that repeats without end is one task's.

Defined results: sources are ranked by code point with null last; a null text
has no words, and a text of any length counts whole; a source without words
has target 0; a document of no words is taken once per whole pass; equal rows
are separate documents, any of which may be taken; an empty table gives no
rows; input columns other than doc_id, text, source and the row number
``common.ROW`` are ignored, whatever their names.  What is taken depends on
the rows and the seed alone.  More than ``most_sources`` sources are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cells_for, materialize, prefix_sum, row_id, skew_join, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    shards: int = 16
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # repeat over the sources in order
    most_repeats: float = 3.0
    block_words: int = 16_384
    most_blocks: int = 1 << 24  # the blocks grow beyond block_words rather than exceed this number
    most_sources: int = 100_000  # one row of each is broadcast; a mixture of more is refused
    seed: int = 20_240_601


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets: the whole, shared by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    total, capped = float(sum(sizes)), [s == 0 for s in sizes]
    out = [0.0] * len(sizes)
    while not all(capped):
        left = total - sum(o for o, c in zip(out, capped, strict=True) if c)
        open_weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        share = [left * w / open_weight for w in weights]
        over = [not c and x > most * s for x, s, c in zip(share, sizes, capped, strict=True)]
        if not any(over):
            return [o if c else x for o, x, c in zip(out, share, capped, strict=True)]
        for i, is_over in enumerate(over):
            if is_over:
                out[i], capped[i] = most * sizes[i], True
    return out


def split_tree(draws: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Array (shards, sources): the draws of each source that each shard gets; columns add up to ``draws``."""
    if shards == 1:
        return np.array([draws], dtype=np.int64)
    left_shards = shards // 2
    total = sum(draws)
    left = rng.multivariate_hypergeometric(draws, total * left_shards // shards, method="marginals") if total else np.zeros(len(draws), dtype=np.int64)
    right = np.array(draws, dtype=np.int64) - left
    return np.vstack([split_tree([int(x) for x in left], left_shards, rng), split_tree([int(x) for x in right], shards - left_shards, rng)])


def _boundary(rows: DataFrame, cells: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the further pass takes of the blocks at the boundary: (classes of equal rows taken whole, classes taken in part, the words that each source has open then).

    ``rows`` have k, h, size, extra (1 in the block at the boundary, 0 beyond) and room, the words open there.
    A source has at most one class taken in part.
    """
    ticket = F.xxhash64(F.lit(seed), F.lit("edge"), "h")
    classes = rows.filter("extra = 1 AND size > 0").groupBy("k", "h", "size", "room").agg(F.count(F.lit(1)).alias("n")).withColumn("ticket", ticket)
    classes = materialize(classes, "mix-edge")
    edge = prefix_sum(classes, ["k"], ["ticket", "h", "size"], F.col("n") * F.col("size"), "at", cells)
    fit = F.floor((F.col("room") - F.col("at")) / F.col("size"))
    edge = materialize(edge.withColumn("m", F.greatest(F.lit(0), F.least("n", fit))), "mix-edge")
    still = rows.filter("extra = 1").groupBy("k").agg(F.max("room").alias("room"))  # one row a source, as every broadcast here
    spent = edge.groupBy("k").agg(F.sum(F.col("m") * F.col("size")).alias("spent"))
    still = still.join(F.broadcast(spent), "k", "left").select("k", (F.col("room") - F.coalesce("spent", F.lit(0))).alias("open"))
    part = edge.filter("m > 0 AND m < n").select("k", "h", "size", F.col("m").alias("take"))
    return edge.filter("m = n").select("k", "h", "size", "n"), part, materialize(still.filter("open > 0"), "mix-open")


def fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How many of each size fill the room: the largest first while they fit, then one of the least size left if that comes nearer."""
    out: dict[int, int] = {}
    left = dict(zip(sizes, counts, strict=True))
    for size in sorted(left, reverse=True):
        if (m := min(left[size], room // size)) > 0:
            out[size], room = m, room - m * size
            left[size] -= m
    least = min((s for s, n in left.items() if n > 0), default=None)
    if least is not None and least - room < room:
        out[least] = out.get(least, 0) + 1
    return out


def _filled(rows: DataFrame, still: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """``rows`` (k, h, size, rid, taken, ...) with those taken that fill what each source has open."""
    free = rows.filter("taken IS NULL AND size > 0")
    sizes = free.join(F.broadcast(still), "k").filter(F.col("size") < 2 * F.col("open")).groupBy("k", "size", "open").agg(F.count(F.lit(1)).alias("n"))

    def plan(own: pd.DataFrame) -> pd.DataFrame:
        picked = fill(own["size"].tolist(), own["n"].tolist(), int(own["open"].iloc[0]))
        own = own[own["size"].isin(list(picked))]
        return pd.DataFrame({"k": own["k"], "size": own["size"], "n": own["n"], "take": own["size"].map(picked)})

    # a source of W words has at most sqrt(2 W) different sizes
    plans = materialize(sizes.groupBy("k").applyInPandas(plan, "k int, size long, n long, take long"), "mix-fill")
    tagged = skew_join(free, plans.withColumnRenamed("take", "fill"), ["k", "size"], "n", n_rows, ["rid"], "left").drop("n")
    tagged = materialize(tagged.withColumn("ticket", F.xxhash64(F.lit(seed), F.lit("fill"), "h")), "mix-fill")
    picked = prefix_sum(tagged.filter("fill IS NOT NULL"), ["k", "size"], ["ticket", "rid"], F.lit(1), "rank", cells_for(n_rows))
    picked = picked.withColumn("taken", F.when(F.col("rank") < F.col("fill"), 1)).drop("rank")
    out = tagged.filter("fill IS NULL").unionByName(picked).drop("fill", "ticket")
    return rows.filter("taken IS NOT NULL OR size = 0").unionByName(out)


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """All columns of ``docs`` replaced by: rid, doc_id, source, size, source_size, target, copies, shards (one per copy), order_key.

    ``rid`` numbers the rows, as ``common.number_rows`` does.
    """
    spark, seed = docs.sparkSession, config.seed
    rows = docs.select(
        row_id(docs).alias("rid"), "doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("h"),
    )
    rows = materialize(rows, "mix-rows")
    per_name = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    n_sources, n_rows = per_name.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_sources > config.most_sources or n_sources * config.shards > 1 << 24:
        raise ValueError(f"{n_sources} sources are more than a plan on the driver takes")
    sums = sorted(((r["source"], int(r["s"])) for r in per_name.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in sums]
    targets = water_fill(sizes, [config.weights[i % len(config.weights)] for i in range(len(sums))], config.most_repeats)
    block_words = max(config.block_words, math.ceil(sum(sizes) / config.most_blocks))
    n_blocks = [max(16, math.ceil(s / block_words)) for s in sizes]
    whole = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    part = [min(s, round(t - w * s)) for t, s, w in zip(targets, sizes, whole, strict=True)]
    per_source = spark.createDataFrame(
        [(i, src, s, t, b, w, p) for i, ((src, s), t, b, w, p) in enumerate(zip(sums, targets, n_blocks, whole, part, strict=True))],
        "k int, src string, source_size long, target double, n_blocks int, whole int, part long",
    )
    rows = rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h"), F.col("n_blocks")).cast("int"))
    blocks = rows.groupBy("k", "block", "whole", "part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    blocks = materialize(blocks.withColumn("draw", F.xxhash64(F.lit(seed), F.lit("extra"), "k", "block")), "mix-blocks")
    cells = cells_for(sum(n_blocks))
    blocks = prefix_sum(blocks, ["k"], ["draw", "block"], F.col("words"), "before", cells)
    # 2: the whole block is in the further pass; 1: some of its documents may be; 0: none
    stage = F.when(F.col("part") == 0, 0).when(F.col("before") + F.col("words") <= F.col("part"), 2).when(F.col("before") < F.col("part"), 1).otherwise(0)
    blocks = materialize(blocks.select("k", "block", "whole", "n", stage.alias("extra"), (F.col("part") - F.col("before")).alias("room")), "mix-blocks")
    rows = skew_join(rows.drop("n_blocks", "part"), blocks.select("k", "block", "n", "extra", "room"), ["k", "block"], "n", n_rows, ["rid"]).drop("n")
    rows = materialize(rows, "mix-placed")
    edge_cells = cells_for(block_words)
    full, some, still = _boundary(rows, edge_cells, seed)
    one = F.lit(1)
    in_edge = skew_join(rows.filter("extra = 1"), full.withColumn("taken", one), ["k", "h", "size"], "n", n_rows, ["rid"], "left").drop("n")
    rows = rows.filter("extra <> 1").withColumn("taken", F.when(F.col("extra") == 2, one)).unionByName(in_edge)
    rows = materialize(rows.join(F.broadcast(some), ["k", "h", "size"], "left"), "mix-taken")
    chosen = prefix_sum(rows.filter("take IS NOT NULL"), ["k", "h", "size"], ["rid"], one, "rank", cells_for(n_rows))
    chosen = chosen.withColumn("taken", F.when(F.col("rank") < F.col("take"), one)).drop("rank")
    rows = materialize(rows.filter("take IS NULL").unionByName(chosen).drop("take"), "mix-chosen")
    rows = _filled(rows, still, n_rows, seed).withColumn("copies", F.col("whole") + F.coalesce("taken", F.lit(0)))

    # draws: every block once per whole pass, and the blocks of the further pass
    present = {r["k"]: (int(r["n"]), int(r["x"])) for r in blocks.groupBy("k").agg(F.count(one).alias("n"), F.sum((F.col("extra") > 0).cast("long")).alias("x")).toLocalIterator()}
    draws = [present[i][0] * whole[i] + present[i][1] for i in range(len(sums))]
    quotas = split_tree(draws, config.shards, np.random.default_rng(seed)) if sums else np.zeros((config.shards, 0), dtype=np.int64)
    ends = np.cumsum(quotas, axis=0)
    plan = spark.createDataFrame([(i, present[i][0], [int(x) for x in ends[:, i]]) for i in range(len(sums))], "k int, present long, ends array<bigint>")
    # place of a block among the draws of its source: pass after pass, each in its own permutation
    drawn = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    drawn = drawn.filter((F.col("pass") < F.col("whole")) | (F.col("extra") > 0)).withColumn("draw", F.xxhash64(F.lit(seed), "pass", "k", "block"))
    drawn = prefix_sum(drawn, ["k", "pass"], ["draw", "block"], one, "turn", cells).join(F.broadcast(plan), "k")
    place = F.col("pass") * F.col("present") + F.col("turn")
    drawn = drawn.withColumn("shard", F.size(F.filter("ends", lambda e: e <= place)))
    homes = drawn.groupBy("k", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))
    out = skew_join(rows, homes, ["k", "block"], "n", n_rows, ["rid"], "left")
    shards = F.slice(F.coalesce(F.transform("homes", lambda x: x["shard"]), F.array().cast("array<int>")), F.lit(1), F.col("copies"))
    # documents that fill up a source may be of a block that is not drawn again
    spare = F.array(F.pmod(F.xxhash64(F.lit(seed), F.lit("fill"), "h"), F.lit(config.shards)).cast("int"))
    out = out.withColumn("shards", shards).withColumn("shards", F.when(F.size("shards") < F.col("copies"), F.concat("shards", spare)).otherwise(F.col("shards")))
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", "copies", "shards", F.xxhash64(F.lit(seed + 1), "h").alias("order_key"))


def shuffled(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows (shard, order_key, ...) dealt by shard and a part of the key, each part in the order of its keys: the local shuffle."""
    parts = max(1, math.ceil(n_rows / 100_000))
    dealt = rows.withColumn("__part", F.pmod(F.col("order_key"), F.lit(parts)))
    return dealt.repartition("shard", "__part").sortWithinPartitions("shard", "__part", "order_key").drop("__part")
