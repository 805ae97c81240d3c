"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are majority votes of 64-bit shingle hashes.  The bits are
grouped into parts so that correlated bits share a part; thresholds t_i >= -1
with sum(t_i + 1) = radius + 1 guarantee that two fingerprints within the
radius agree up to t_i bits on at least one part.  The number of parts and the
unequal thresholds come from dynamic programming over candidate counts, which
are estimated on a bounded sample of fingerprints; the sample shapes the index
only, every fingerprint is indexed and every candidate verified, so no link is
lost.

A part with t = 0 is probed by its value, t = 1 by the value and the values
with one set bit cleared, t = 2 by all values at distance one.  Rows meet by a
shuffle on (part, value) and are verified in sorted order by vectorised
comparison; a run of over SHORT_RUN rows is joined through a pivot, so it
yields fewer links than members.  Values are counted first: the rows of a value
beyond RUN_LIMIT never meet in one task, but are dealt again by a further
pigeonhole over the bits their part has not used, until no run is longer.

Defined results: null or wordless text has fingerprint zero, linked like any
other; a text of any length is read whole; equal fingerprints are one node;
repeated rows are separate documents; a null doc_id takes part but is never the
component's id unless all are null; an empty table gives no rows; columns other
than doc_id, text and the row number ``common.ROW`` are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import MOST_HOT, materialize, row_id, skew_join, stored_join, text_or_empty
from corvane.llm.components import connected_components

SEED = 42
SAMPLE = 32_768
RUN_LIMIT = 50_000
SHORT_RUN = 24
BLOCK = 1 << 21  # comparisons held at once


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    radius: int = 2
    words64: int = 1  # fingerprint length in 64-bit words
    distinct: bool = False  # features once per document instead of as often as they occur


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).astype(">u8").view(np.uint8).reshape(len(hashes), -1), axis=1)


def fingerprint(text: str | None, config: SimHashConfig = SimHashConfig()) -> list[int]:
    """The fingerprint as signed 64-bit words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return [0] * config.words64
    k = config.shingle
    if len(words) < k:
        shingles = [b" ".join(words)]
    elif k == 1:
        shingles = words
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        shingles = [line[s:e] for s, e in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]
    if config.distinct:
        shingles = sorted(set(shingles))
    out = []
    for word in range(config.words64):
        count = np.zeros(64, dtype=np.int64)
        for at in range(0, len(shingles), 65_536):
            part = shingles[at : at + 65_536]
            h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED + word)), dtype=np.uint64, count=len(part))
            count += _bits(h[:, None]).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > len(shingles)).view(">u8")[0].astype(np.int64)))
    return out


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """rid, doc_id, w0.. (longs) for every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, config) for t in texts])

    fp = F.pandas_udf(run, "array<bigint>")
    rows = docs.select(row_id(docs).alias("rid"), "doc_id", fp(text_or_empty()).alias("fp"))
    return rows.select("rid", "doc_id", *[F.col("fp")[i].alias(f"w{i}") for i in range(config.words64)])


# ---- the index: parts and thresholds


@dataclass(frozen=True)
class Layout:
    parts: tuple[tuple[int, ...], ...]  # bits, most significant first within a word
    thresholds: tuple[int, ...]


def _group_bits(corr: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Correlated bits share a part; the parts' widths differ by at most one."""
    free, out, n = set(range(len(corr))), [], len(corr)
    for p in range(parts):
        width = n // parts + (p < n % parts)
        rest = sorted(free)
        sub = corr[np.ix_(rest, rest)]
        part = [rest[int(np.argmax(sub.sum(axis=1)))]]
        free.discard(part[0])
        while len(part) < width:
            rest = sorted(free)
            part.append(rest[int(np.argmax(corr[np.ix_(part, rest)].sum(axis=0)))])
            free.discard(part[-1])
        out.append(tuple(sorted(part)))
    return out


def _costs(bits: np.ndarray, part: tuple[int, ...], total: int) -> list[float]:
    """Estimated cost of thresholds -1, 0, 1, 2 on a part: rows shuffled, and candidate pairs."""
    sub, n, w = bits[:, part], len(bits), len(part)
    _, counts = np.unique(np.packbits(sub, axis=1), axis=0, return_counts=True)
    collide = float((counts * (counts - 1)).sum()) / max(1, n * (n - 1))
    share = sub.mean(axis=0)
    differ = np.clip(2 * share * (1 - share), 1e-6, 0.5)
    one = differ / (1 - differ)
    even = float(np.prod(1 - differ))
    p0 = max(collide, even)
    p1 = p0 * (1 + one.sum())
    p2 = p1 + p0 * (one.sum() ** 2 - (one**2).sum()) / 2
    rows = [0.0, 1.0, 1.0 + float(share.sum()), 1.0 + w]
    pairs = [0.0, p0, p1, p2]
    return [8.0 * total * r + 0.05 * total * total / 2 * p for r, p in zip(rows, pairs, strict=True)]


def plan_index(sample: np.ndarray, total: int, radius: int) -> Layout:
    """Cheapest parts and thresholds for ``total`` fingerprints, from the bits (rows, bits) of a sample."""
    n, n_bits = sample.shape
    both = np.zeros((n_bits, n_bits))
    for at in range(0, n, 1_024):  # the whole sample as doubles takes tens of megabytes of the driver
        x = sample[at : at + 1_024].astype(float)
        both += x.T @ x
    ones = np.diag(both)
    cov = both - np.outer(ones, ones) / n
    norm = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / norm[:, None] / norm)
    np.fill_diagonal(corr, 0)
    best: tuple[float, Layout] | None = None
    for m in range(max(2, n_bits // 60 + 1), min(max(3, n_bits // 10), 14) + 1):
        parts = _group_bits(corr, m)
        # least cost with a given sum of (t + 1) over the parts so far
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            cost = _costs(sample, part, total)
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in table.items():
                for t in (-1, 0, 1, 2):
                    to, price = s + t + 1, c + cost[t + 1]
                    if to <= radius + 1 and (to not in step or price < step[to][0]):
                        step[to] = (price, (*ts, t))
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], Layout(tuple(parts), table[radius + 1][1]))
    assert best is not None, "the radius is too large for the fingerprint's length"
    return best[1]


def _project(words: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    key = np.zeros(len(words), dtype=np.uint64)
    for b in part:
        key = (key << np.uint64(1)) | ((words[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
    return key


def _probes(words: np.ndarray, layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, row numbers, keys)"""
    every = np.arange(len(words))
    for p, (part, t) in enumerate(zip(layout.parts, layout.thresholds, strict=True)):
        if t < 0:
            continue
        key = _project(words, part)
        yield p, every, key
        for k in range(len(part) if t else 0):
            flip = np.uint64(1 << k)
            if t == 1:
                on = np.flatnonzero(key & flip)
                yield p, on, key[on] ^ flip
            else:
                yield p, every, key ^ flip


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _run_links(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect a run's members exactly as all its pairs within the radius would."""
    n = len(words)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    links: list[tuple[int, int]] = []

    def link(i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))

    near = np.flatnonzero(_popcount(words ^ words[0]) <= radius)
    link(0, near[near != 0])
    loose = np.setdiff1d(np.arange(n), near)  # pairs inside ``near`` are connected already
    step = max(1, BLOCK // n)
    for at in range(0, len(loose), step):
        block = loose[at : at + step]
        hit_i, hit_j = np.nonzero(_popcount(words[block][:, None, :] ^ words[None, :, :]) <= radius)
        flat = np.array([find(i) for i in range(n)])
        gi = block[hit_i]
        fresh = flat[gi] != flat[hit_j]
        pairs = np.unique(np.stack([flat[gi][fresh], flat[hit_j][fresh], gi[fresh], hit_j[fresh]], axis=1), axis=0) if fresh.any() else np.zeros((0, 4), dtype=np.int64)
        for _, _, i, j in pairs.tolist():
            link(i, np.array([j]))
    return links


def _verify(radius: int, width: int):
    """Sorted rows (part, key, node, w...) to links; holds the run it is in and no more than a few batches besides."""
    cols = [f"w{i}" for i in range(width)]

    def flush(rows: pa.Table) -> pa.RecordBatch:
        part = rows["part"].to_numpy()
        key = rows["key"].to_numpy()
        node = rows["node"].to_numpy()
        words = np.stack([rows[c].to_numpy() for c in cols], axis=1).astype(np.int64).view(np.uint64)
        cut = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(part)]])
        length = ends - starts
        a, b = [], []
        short = np.repeat(length <= SHORT_RUN, length)
        last = np.repeat(ends, length)
        for d in range(1, min(SHORT_RUN, int(length.max(initial=1)))):
            i = np.flatnonzero(short & (np.arange(len(part)) + d < last))
            if not len(i):
                break
            ok = i[_popcount(words[i] ^ words[i + d]) <= radius]
            a.append(node[ok])
            b.append(node[ok + d])
        for s, e in zip(starts[length > SHORT_RUN].tolist(), ends[length > SHORT_RUN].tolist(), strict=True):
            pairs = np.array(_run_links(words[s:e], radius), dtype=np.int64).reshape(-1, 2)
            a.append(node[s + pairs[:, 0]])
            b.append(node[s + pairs[:, 1]])
        left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
        keep = left != right
        pairs = np.unique(np.stack([np.minimum(left, right)[keep], np.maximum(left, right)[keep]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[pa.RecordBatch] = []  # runs that have ended
        tail: list[pa.RecordBatch] = []  # the run that may go on
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key = batch.column("part").to_numpy(), batch.column("key").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or at != (part[0], key[0]):
                whole += [*tail, batch.slice(0, cut)]
                tail = []
            tail.append(batch.slice(cut))
            at = (part[-1], key[-1])
            if sum(b.num_rows for b in whole) >= 50_000:
                yield flush(pa.Table.from_batches(whole).combine_chunks())
                whole = []
        if whole or tail:
            yield flush(pa.Table.from_batches([*whole, *tail]).combine_chunks())

    return run


def _emit(layout: Layout, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(1 + i).to_numpy() for i in range(width)], axis=1).view(np.uint64)
            used = [np.zeros(width, dtype=np.uint64) for _ in layout.parts]
            for p, part in enumerate(layout.parts):
                for b in part:
                    used[p][b // 64] |= np.uint64(1 << (63 - b % 64))
            node = batch.column(0)
            for p, at, key in _probes(words, layout):
                if not len(at):
                    continue
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), p, dtype=np.int32)), pa.array(key.view(np.int64)), node.take(took), *[batch.column(1 + i).take(took) for i in range(width)], *[pa.array(np.full(len(at), used[p][i]).view(np.int64)) for i in range(width)]],
                    names=["part", "key", "node", *[f"w{i}" for i in range(width)], *[f"u{i}" for i in range(width)]],
                )

    return run


def _refine(radius: int, width: int):
    """Rows of a long run, each once per group of its part's unused bits: two that are within the radius agree on one of radius + 1 groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for mask, own in rows.groupby([f"u{i}" for i in range(width)]):
                mask = np.array(mask if isinstance(mask, tuple) else (mask,), dtype=np.int64).view(np.uint64)
                free = [b for b in range(64 * width) if not (int(mask[b // 64]) >> (63 - b % 64)) & 1]
                words = own[[f"w{i}" for i in range(width)]].to_numpy(np.int64).view(np.uint64)
                for g in range(radius + 1):
                    bits = tuple(free[g :: radius + 1])
                    key = own["key"].to_numpy(np.int64).view(np.uint64)
                    for b in bits:
                        bit = (words[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1)
                        key = (key ^ bit) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1)
                    used = mask.copy()
                    for b in bits:
                        used[b // 64] |= np.uint64(1 << (63 - b % 64))
                    out = {"part": np.full(len(own), g, dtype=np.int32), "key": key.view(np.int64), "node": own["node"].to_numpy()}
                    out |= {f"w{i}": own[f"w{i}"].to_numpy() for i in range(width)} | {f"u{i}": np.full(len(own), used[i]).view(np.int64) for i in range(width)}
                    yield pd.DataFrame(out)

    return run


def _of_values(probes: DataFrame, values: DataFrame, within: bool, total: int, broadcast: bool) -> DataFrame:
    """The probes whose (part, key) is, or is not, among the values (part, key, n): they go to every task, or meet by a join that deals a value's rows."""
    keys = ["part", "key"]
    if broadcast:
        return probes.join(F.broadcast(values.select(*keys)), keys, "left_semi" if within else "left_anti")
    both = skew_join(probes, values.withColumn("met", F.lit(True)), keys, "n", total, ["node"], "inner" if within else "left")
    return (both if within else both.filter("met IS NULL")).select(*probes.columns)


def _sample(words: DataFrame, total: int) -> np.ndarray:
    """The bits of about SAMPLE of ``total`` fingerprints, chosen by a hash of their own: the least of each task would grow with the tasks."""
    if total > SAMPLE:
        words = words.filter(F.pmod(F.xxhash64(F.lit(SEED), *words.columns), F.lit(total)) < SAMPLE)
    found = words.toArrow()
    return _bits(np.stack([c.to_numpy() for c in found.columns], axis=1).view(np.uint64))


def links(nodes: DataFrame, radius: int, width: int, limit: int = RUN_LIMIT, most_broadcast: int = MOST_HOT) -> DataFrame:
    """Links (a, b) that connect the nodes (node, w0..; fingerprints distinct) as all pairs within the radius would.

    No run of more than ``limit`` rows is compared in one task, whatever the
    size of the input; up to ``most_broadcast`` values of longer runs are
    broadcast, more are joined.
    """
    words = [f"w{i}" for i in range(width)]
    total = nodes.count()
    if total < 2:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    layout = plan_index(_sample(nodes.select(*words), total), total, radius)
    row = "part int, key long, node long, " + ", ".join(f"{w} long" for w in [*words, *[f"u{i}" for i in range(width)]])
    probes = nodes.select("node", *words).mapInArrow(_emit(layout, width), row)
    most = total * sum((0, 1, 1 + len(p), 1 + len(p))[t + 1] for p, t in zip(layout.parts, layout.thresholds, strict=True))
    free = F.lit(64 * width) - sum((F.bit_count(F.col(f"u{i}")) for i in range(width)), F.lit(0))
    found = None
    while True:
        # a value with no more free bits than the radius has few rows, as nodes differ
        counts = probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.max(free).alias("free"))
        long = materialize(counts.filter((F.col("n") > limit) & (F.col("free") > radius)).select("part", "key", "n"), "simhash-long")
        n_long = long.count()
        small = n_long <= most_broadcast
        short = _of_values(probes, long, False, most, small) if n_long else probes
        meet = short.select("part", "key", "node", *words).repartition("part", "key").sortWithinPartitions("part", "key")
        new = materialize(meet.mapInArrow(_verify(radius, width), "a long, b long"), "simhash-links")
        found = new if found is None else found.unionByName(new)
        if not n_long:
            return found
        again = materialize(_of_values(probes, long, True, most, small), "simhash-again")
        most = (radius + 1) * again.count()
        probes = again.mapInPandas(_refine(radius, width), row)


def _components(docs: DataFrame, config: SimHashConfig) -> tuple[DataFrame, DataFrame]:
    """Stored: the fingerprint of every row; and of each fingerprint (w0..) its copies, its first row (nameless, doc_id, rid), that is by doc_id, null last, then by rid, and its component's root."""
    words = [f"w{i}" for i in range(config.words64)]
    rows = materialize(fingerprints(docs, config), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid")).alias("first")
    nodes = materialize(rows.groupBy(*words).agg(first, F.count(F.lit(1)).alias("copies"), F.min("rid").alias("node")), "simhash-nodes")
    roots = connected_components(links(nodes, config.radius, config.words64))
    tree = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, materialize(tree.select(*words, "first", "copies", "root"), "simhash-roots")


def near_duplicates(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """rid, doc_id, w0.., component_id (least doc_id of the component), root (least rid of it) for every row.

    ``root`` tells components apart where doc_ids are null or repeated.
    """
    words = [f"w{i}" for i in range(config.words64)]
    rows, tree = _components(docs, config)
    total = rows.count()
    names = materialize(tree.groupBy("root").agg(F.min("first.doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-names")
    named = materialize(stored_join(tree, names, ["root"], "n", total, words).select(*words, "copies", "component_id", "root"), "simhash-named")
    return stored_join(rows, named, words, "copies", total, ["rid"]).select("rid", "doc_id", *words, "component_id", "root")


def first_rows(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """rid of each component's first row, by doc_id, null last, then by rid; rows meet by fingerprint only, so they are joined with nothing."""
    _, tree = _components(docs, config)
    return tree.groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
