"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (rows with one key) are sorted by size and each enters the
bin with the tightest remaining capacity that still holds it, found in a
balanced search tree; a new bin is opened when none fits.  For a stated number
of shards the least capacity that needs no more bins is found by bisection,
which makes sizes near equal.

Groups below a unit of total/(shards * UNITS) bytes are first packed, by the
same rule and inside hash buckets of about BUCKET_GROUPS groups, into bundles
of one unit.  A bucket leaves at most one bundle that is half full or less;
those bundles are packed again, in buckets of as many, until one at most is
left.  So no more than 4 * shards * UNITS + 1 bundles come to the driver,
however many rows or groups there are, and their plan is broadcast.

Defined results: a null text is the empty text; texts of any length are one
group each with their copies; groups of equal size are ordered by their
digest; repeated rows are separate rows of one group; an empty table gives no
rows; columns other than doc_id, text and the row number ``common.ROW`` are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cells_for, materialize, prefix_sum, row_id, skew_join, text_or_empty

#: Bundles per shard, at least, once the groups are small.
UNITS = 128
#: Groups that one bucket of the first packing aims at.
BUCKET_GROUPS = 20_000


class BestFitTree:
    """AA tree over (remaining capacity, bin): insert, and take the least entry not below a bound, in O(log n)."""

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = [(0, 0)]
        self.left, self.right, self.level = [0], [0], [0]
        self.free: list[int] = []
        self.root = 0

    def _skew(self, n: int) -> int:
        child = self.left[n]
        if n and self.level[child] == self.level[n]:
            self.left[n], self.right[child] = self.right[child], n
            return child
        return n

    def _split(self, n: int) -> int:
        child = self.right[n]
        if n and self.level[self.right[child]] == self.level[n]:
            self.right[n], self.left[child] = self.left[child], n
            self.level[child] += 1
            return child
        return n

    def insert(self, key: tuple[int, int]) -> None:
        if self.free:
            new = self.free.pop()
            self.key[new], self.left[new], self.right[new], self.level[new] = key, 0, 0, 1
        else:
            new = len(self.key)
            self.key.append(key)
            self.left.append(0)
            self.right.append(0)
            self.level.append(1)
        self.root = self._insert(self.root, new)

    def _insert(self, n: int, new: int) -> int:
        if not n:
            return new
        if self.key[new] < self.key[n]:
            self.left[n] = self._insert(self.left[n], new)
        else:
            self.right[n] = self._insert(self.right[n], new)
        return self._split(self._skew(n))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least entry whose remaining capacity is at least ``size``."""
        n, best = self.root, 0
        while n:
            if self.key[n][0] >= size:
                best, n = n, self.left[n]
            else:
                n = self.right[n]
        if not best:
            return None
        found = self.key[best]
        self.root = self._delete(self.root, found)
        return found

    def _delete(self, n: int, key: tuple[int, int]) -> int:
        if not n:
            return 0
        if key < self.key[n]:
            self.left[n] = self._delete(self.left[n], key)
        elif key > self.key[n]:
            self.right[n] = self._delete(self.right[n], key)
        elif not self.left[n] and not self.right[n]:
            self.free.append(n)
            return 0
        else:
            down, up = (self.right, self.left) if not self.left[n] else (self.left, self.right)
            at = down[n]
            while up[at]:
                at = up[at]
            swap = self.key[at]
            down[n] = self._delete(down[n], swap)
            self.key[n] = swap
        level = min(self.level[self.left[n]], self.level[self.right[n]]) + 1
        if level < self.level[n]:
            self.level[n] = level
            self.level[self.right[n]] = min(level, self.level[self.right[n]])
        n = self._skew(n)
        self.right[n] = self._skew(self.right[n])
        self.right[self.right[n]] = self._skew(self.right[self.right[n]])
        n = self._split(n)
        self.right[n] = self._split(self.right[n])
        self.left[0] = self.right[0] = self.level[0] = 0
        return n


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; an item above the capacity gets a bin of its own.  None once more than ``most`` bins are open."""
    tree, bins, out = BestFitTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), bins)
            bins += 1
            if most is not None and bins > most:
                return None
        out[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return out


def balanced_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, from the least capacity with which best fit needs no more than the shards there are.

    Items above the mean of what remains get shards of their own first, so one
    huge group does not raise the capacity of the others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, left, total, k = [0] * len(sizes), shards, sum(sizes), 0
    while k < len(order) and left > 1 and sizes[order[k]] * left > total:
        out[order[k]] = shards - left
        total -= sizes[order[k]]
        left, k = left - 1, k + 1
    rest, first = order[k:], shards - left
    if not rest:
        return out
    items = [sizes[i] for i in rest]
    low = max(math.ceil(total / left), items[0])
    high = low + items[0] + 1
    best = None
    while best is None:
        best = best_fit_decreasing(items, high, left)
        low, high = (low, high) if best is not None else (high + 1, 2 * high)
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(items, mid, left)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    for i, b in zip(rest, best, strict=True):
        out[i] = first + b
    return out


def _bundle(unit: int, level: int):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item", kind="stable")
        bins = best_fit_decreasing([int(x) for x in items["size"]], unit)
        return pd.DataFrame({"item": items["item"].to_numpy(), "bundle": [f"{level}/{key[0]}/{b}" for b in bins]})

    return pack


def _pack_buckets(items: DataFrame, count: int, unit: int, level: int) -> DataFrame:
    """(item, bundle) for items (item, size): best fit decreasing inside hash buckets."""
    buckets = max(1, math.ceil(count / BUCKET_GROUPS))
    dealt = items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(_bundle(unit, level), "item string, bundle string")


def bundle_groups(groups: DataFrame, unit: int) -> DataFrame:
    """``groups`` (grp, gsize, ...) with their bundle; of all bundles at most one is half a unit or less."""
    items = groups.select(F.hex("grp").alias("item"), F.col("gsize").alias("size"))
    small = items.filter(F.col("size") < unit)
    large = items.filter(F.col("size") >= unit).select("item", F.concat(F.lit("L"), F.col("item")).alias("bundle"))
    placed = groups.withColumn("item", F.hex("grp")).join(large.unionByName(_pack_buckets(small, small.count(), unit, 0)), "item").drop("item")
    placed, level = materialize(placed, "shard-bundles"), 0
    while True:
        loose = placed.groupBy(F.col("bundle").alias("item")).agg(F.sum("gsize").alias("size")).filter(F.col("size") * 2 <= unit)
        left = loose.count()
        if left <= 1:
            return placed
        level += 1
        again = _pack_buckets(loose, left, unit, level).withColumnRenamed("bundle", "outer")
        placed = placed.join(again, F.col("bundle") == F.col("item"), "left").withColumn("bundle", F.coalesce("outer", "bundle")).drop("item", "outer")
        placed = materialize(placed, "shard-bundles")


def assign_shards(docs: DataFrame, shards: int, units: int = UNITS) -> DataFrame:
    """Put all rows into ``shards`` shards; rows with equal text stay together.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard and slot, which
    counts a shard's rows gaplessly from 0.
    """
    spark = docs.sparkSession
    body = text_or_empty()
    rows = materialize(
        docs.select(row_id(docs).alias("rid"), "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("grp")),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("grows")), "shard-groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("gsize"), F.lit(0)), F.coalesce(F.sum("grows"), F.lit(0))).first()
    placed = bundle_groups(groups, max(1, total // (shards * units)))
    items = sorted((r["bundle"], int(r["s"])) for r in placed.groupBy("bundle").agg(F.sum("gsize").alias("s")).toLocalIterator())  # 4 * shards * units + 1 at most
    assert len(items) <= 4 * shards * units + 1, "the bundles are bounded by their unit"
    shard_of = balanced_shards([s for _, s in items], shards) if items else []
    plan = spark.createDataFrame([(b, k) for (b, _), k in zip(items, shard_of, strict=True)], "bundle string, shard int")
    by_group = placed.join(F.broadcast(plan), "bundle").select("grp", "grows", "shard")
    out = materialize(skew_join(rows, by_group, ["grp"], "grows", n_rows, ["rid"]).select("rid", "doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return prefix_sum(out, ["shard"], ["rid"], F.lit(1), "slot", cells_for(max(1, n_rows // shards))).drop("rid")
