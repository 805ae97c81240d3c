"""Ranked lexical search over inverted treaps.

Documents are dealt to segments as they are read.  A segment holds, for each
of its terms, the postings in order of doc_id, and over them a treap: nodes in
search order by document and in heap order by impact, so that a node's impact
is the largest of its subtree; subtrees of few postings are kept flat, with
their maximum.  A query walks the treaps of its terms together, from the whole
range of documents down.  A range is worth at most the sum, over the terms, of
weight times the impact of the root of what the term's treap has there; a
range that cannot enter the top k is left out with everything below it.  Else
it is cut at the document of the heaviest root, which is scored, and each
treap descends to its roots in the two halves.  The ranges of most worth come
first.

Integer scores: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its
impact in a document (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N)
div L; repeats of a term in the query count again.

Statistics (N, L, df) come from all documents before impacts are known, so
building takes two passes: postings, then treaps.  A segment and a block of
queries are one unit of work, whatever the number of either; each gives at
most k rows a query.

Defined results: a null text has no terms and its document is in no result;
null and repeated keys are documents of their own (null last among equal
scores, then by row); repeated queries are ranked each on its own; a query
without a known term, and any query on an empty table, has no rows; texts of
any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import least_rows, materialize

#: ASCII letters are lower-cased, other ASCII but digits parts the terms; bytes of other characters are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class LexicalConfig:
    k: int = 20
    segment_docs: int = 1 << 15
    segment_postings: int = 1 << 20
    flat: int = 64  # postings under which a subtree is kept flat
    narrow: int = 64  # documents, for each term of the query, under which a range is scored at once
    block_queries: int = 256
    broadcast_terms: int = 1 << 18  # terms of queries that go to every task; more of them meet their data by a shuffle


@dataclass(frozen=True)
class TreapIndex:
    segments: DataFrame
    terms: DataFrame  # term, weight
    config: LexicalConfig


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, with repeats, as UTF-8."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


# ---- building

_POSTINGS = "terms array<string>, df array<int>, docs array<int>, tf array<int>, keys array<{key}>, lengths array<bigint>"


class _Gather:
    """Documents of one segment until it is full."""

    def __init__(self) -> None:
        self.keys: list[Any] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.n = 0

    def add(self, key: Any, length: int, counts: list[tuple[bytes, int]]) -> None:
        at = len(self.keys)
        self.keys.append(key)
        self.lengths.append(length)
        for term, tf in counts:
            own = self.lists.get(term)
            if own is None:
                own = self.lists[term] = ([], [])
            own[0].append(at)
            own[1].append(tf)
        self.n += len(counts)

    def batch(self, key_type: pa.DataType) -> pa.RecordBatch:
        """One row, its documents renumbered in order of their keys, null last."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] if self.keys[i] is not None else 0))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        docs, tfs, names = [], [], sorted(self.lists)
        for name in names:
            at = place[self.lists[name][0]]
            turn = np.argsort(at)
            docs.append(at[turn])
            tfs.append(np.array(self.lists[name][1], dtype=np.int32)[turn])
        none = np.zeros(0, dtype=np.int32)
        row = {
            "terms": pa.array([[t.decode("utf-8", "surrogateescape") for t in names]], pa.list_(pa.string())),
            "df": pa.array([[len(d) for d in docs]], pa.list_(pa.int32())),
            "docs": pa.array([np.concatenate([none, *docs])], pa.list_(pa.int32())),
            "tf": pa.array([np.concatenate([none, *tfs])], pa.list_(pa.int32())),
            "keys": pa.array([[self.keys[i] for i in order]], pa.list_(key_type)),
            "lengths": pa.array([np.array(self.lengths, dtype=np.int64)[order]], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(row)


def _postings(docs: DataFrame, key: str, text: str, asked: frozenset[bytes] | None, config: LexicalConfig) -> DataFrame:
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key_type = _Gather(), pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            texts = batch.column(1).cast(pa.binary())
            for at in range(batch.num_rows):
                terms = terms_of(texts[at].as_py())
                if not terms:
                    continue
                counts = Counter(terms)
                wanted = list(counts.items()) if asked is None else [(t, counts[t]) for t in counts.keys() & asked]
                own.add(batch.column(0)[at].as_py(), len(terms), wanted)
                if len(own.keys) >= config.segment_docs or own.n >= config.segment_postings:
                    yield own.batch(key_type)
                    own = _Gather()
        if own.keys:
            yield own.batch(key_type)

    return docs.select(key, text).mapInArrow(run, _POSTINGS.format(key=kind))


_TREAPS = "terms array<string>, df array<int>, docs array<int>, impacts array<bigint>, keys array<{key}>, roots array<int>, at array<int>, lo array<int>, hi array<int>, top array<bigint>, less array<int>, more array<int>"


def _treap(impacts: np.ndarray, lo: int, hi: int, flat: int, nodes: dict[str, list[int]]) -> int:
    """The root of the treap over postings lo to hi, its nodes appended; node 0 is the empty subtree, a flat one has no posting of its own."""

    def node(lo: int, hi: int) -> int:
        if lo >= hi:
            return 0
        part = impacts[lo:hi]
        if hi - lo <= flat:
            at, top = -1, int(part.max())
        else:
            top = int(part.max())
            same = np.flatnonzero(part == top)  # of equal impacts the one nearest the middle, for depth
            at = lo + int(same[np.argmin(np.abs(same - (hi - lo) // 2))])
            todo.append((len(nodes["at"]), lo, at, hi))
        for name, value in (("at", at), ("lo", lo), ("hi", hi), ("top", top), ("less", 0), ("more", 0)):
            nodes[name].append(value)
        return len(nodes["at"]) - 1

    todo: list[tuple[int, int, int, int]] = []
    root = node(lo, hi)
    while todo:
        own, first, at, last = todo.pop()
        nodes["less"][own] = node(first, at)
        nodes["more"][own] = node(at + 1, last)
    return root


def _treaps(segments: DataFrame, n_docs: int, n_terms: int, config: LexicalConfig) -> DataFrame:
    kind = next(f.dataType.elementType.simpleString() for f in segments.schema if f.name == "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                get = lambda c, row=row: row.column(c).flatten().to_numpy(zero_copy_only=False)
                df, docs, tf, lengths = get("df"), get("docs"), get("tf").astype(np.int64), get("lengths")
                m = 75 + (25 * lengths * n_docs) // n_terms
                impacts = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[docs])
                nodes: dict[str, list[int]] = {"at": [-1], "lo": [0], "hi": [0], "top": [0], "less": [0], "more": [0]}
                ends = np.cumsum(df)
                roots = [_treap(impacts, int(e - n), int(e), config.flat, nodes) for e, n in zip(ends, df, strict=True)]
                out = {c: row.column(c) for c in ("terms", "df", "docs")} | {"impacts": pa.array([impacts], pa.list_(pa.int64())), "keys": row.column("keys")}
                out |= {"roots": pa.array([roots], pa.list_(pa.int32()))}
                out |= {c: pa.array([v], pa.list_(pa.int64() if c == "top" else pa.int32())) for c, v in nodes.items()}
                yield pa.RecordBatch.from_pydict(out)

    return segments.mapInArrow(run, _TREAPS.format(key=kind))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", queries: DataFrame | None = None, query_text: str = "text", config: LexicalConfig = LexicalConfig()) -> TreapIndex:
    """The stored index of all documents; with ``queries``, of the terms that these ask for alone (where they are few enough to tell every task)."""
    asked = None
    if queries is not None:
        found = queries.select(query_text).mapInArrow(_distinct_terms, "term binary").distinct().limit(config.broadcast_terms + 1).collect()
        asked = frozenset(bytes(r["term"]) for r in found) if len(found) <= config.broadcast_terms else None
    held = materialize(_postings(docs, key, text, asked, config), "lexical-postings")
    n_docs, n_terms = held.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    df = held.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.ln((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    terms = materialize(df.select("term", "df", weight.cast("long").alias("weight")), "lexical-terms")
    return TreapIndex(materialize(_treaps(held, int(n_docs), max(1, int(n_terms)), config), "lexical-treaps"), terms, config)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {t for x in batch.column(0).cast(pa.binary()) for t in terms_of(x.as_py())}
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary())})


# ---- searching


class Segment:
    """One segment's treaps as arrays, and the walk over them."""

    def __init__(self, row: pa.RecordBatch) -> None:
        get = lambda c: row.column(c).flatten().to_numpy(zero_copy_only=False)
        self.ids = {t: i for i, t in enumerate(row.column("terms").flatten().to_pylist())}
        self.keys = row.column("keys").flatten()
        self.n_docs = len(self.keys)
        self.docs, self.impacts, df = get("docs").astype(np.int64), get("impacts"), get("df")
        self.roots, self.top, self.less, self.more = get("roots"), get("top"), get("less"), get("more")
        self.base = np.repeat(np.arange(len(df), dtype=np.int64) * self.n_docs, df)
        self.place = self.base + self.docs  # of a term's posting of a document: sorted over all postings
        at, lo, hi = get("at"), get("lo"), get("hi")
        held = self.docs if len(self.docs) else np.zeros(1, dtype=np.int64)
        self.doc = np.where(at >= 0, held[at], -1)
        some = hi > lo
        self.first = np.where(some, held[np.where(some, lo, 0)], self.n_docs)
        self.last = np.where(some, held[np.where(some, hi - 1, 0)], -1)

    def _settle(self, nodes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The roots of what the treaps have in documents lo to hi, going down from nodes above them."""
        while True:
            nodes = np.where((self.last[nodes] < lo) | (self.first[nodes] >= hi), 0, nodes)
            doc = self.doc[nodes]
            right, left = (doc >= 0) & (doc < lo), doc >= hi
            if not (right.any() or left.any()):
                return nodes
            nodes = np.where(right, self.more[nodes], np.where(left, self.less[nodes], nodes))

    def search(self, terms: list[str], weights: list[int], k: int, narrow: int) -> tuple[list[tuple[int, int]], int]:
        """((score, document) of the k best, the best first and of equal scores the first document; how many postings were scored)."""
        known = [(self.ids[t], w) for t, w in zip(terms, weights, strict=True) if t in self.ids and w > 0]
        best: list[tuple[int, int]] = []  # a heap of (score, -document)
        read = 0
        if not known:
            return best, read
        term = np.array([i for i, _ in known], dtype=np.int64) * self.n_docs
        weight = np.array([w for _, w in known], dtype=np.int64)
        nodes = self.roots[[i for i, _ in known]]

        def offer(score: int, doc: int) -> None:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            elif (score, -doc) > best[0]:
                heapq.heapreplace(best, (score, -doc))

        ranges = [(-int((weight * self.top[nodes]).sum()), 0, self.n_docs, nodes)]
        while ranges:
            worth, lo, hi, nodes = heapq.heappop(ranges)
            if len(best) == k and -worth < best[0][0]:
                break  # and so is every range that is left
            worths = weight * self.top[nodes]
            inner = self.doc[nodes] >= 0
            live = np.flatnonzero(worths)
            if hi - lo <= narrow * len(known) or not inner.any():
                a, b = np.searchsorted(self.place, term[live] + lo), np.searchsorted(self.place, term[live] + hi)
                n = b - a
                total = int(n.sum())
                read += total
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)
                sums = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(sums, self.docs[at] - lo, np.repeat(weight[live], n) * self.impacts[at])
                least = best[0][0] if len(best) == k else 1
                fit = np.flatnonzero(sums >= max(1, least))
                if len(fit) > k:
                    fit = fit[np.lexsort((fit, -sums[fit]))[:k]]
                for i in fit.tolist():
                    offer(int(sums[i]), lo + i)
                continue
            cut = int(self.doc[nodes[int(np.argmax(np.where(inner, worths, -1)))]])
            at = np.searchsorted(self.place, term[live] + cut)
            at = np.minimum(at, len(self.place) - 1)
            hit = self.place[at] == term[live] + cut
            read += int(hit.sum())
            offer(int((weight[live][hit] * self.impacts[at[hit]]).sum()), cut)
            for first, last in ((lo, cut), (cut + 1, hi)):
                if first < last:
                    below = self._settle(nodes, first, last)
                    worth = int((weight * self.top[below]).sum())
                    if worth > 0 and not (len(best) == k and worth < best[0][0]):
                        heapq.heappush(ranges, (-worth, first, last, below))
        return [(s, -d) for s, d in sorted(best, key=lambda x: (-x[0], -x[1]))], read


def _query_blocks(index: TreapIndex, queries: DataFrame, query_key: str, query_text: str, config: LexicalConfig) -> tuple[DataFrame, DataFrame, int]:
    """(the queries with a number, one row a block of them with their terms and weights, how many terms there are)."""
    kind = next(f.dataType.simpleString() for f in queries.schema if f.name == query_key)
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("__num"), query_key, F.col(query_text).alias("__text")), "lexical-queries")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts = Counter(terms_of(raw))
                yield pa.RecordBatch.from_pydict({"num": pa.array([num] * len(counts), pa.int64()), "term": pa.array([t.decode("utf-8", "surrogateescape") for t in counts], pa.string()), "times": pa.array(list(counts.values()), pa.int64())})

    pairs = asked.select("__num", "__text").mapInArrow(split, "num long, term string, times long")
    pairs = materialize(pairs.join(index.terms, "term").select("num", "term", (F.col("times") * F.col("weight")).alias("weight")), "lexical-pairs")
    each = pairs.groupBy("num").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("pairs"))
    block = F.pmod(F.xxhash64("num"), F.lit(max(1, -(-asked.count() // config.block_queries))))
    blocks = each.groupBy(block.alias("block")).agg(F.collect_list(F.struct("num", "pairs")).alias("queries"))
    return asked.select("__num", query_key), materialize(blocks, "lexical-blocks"), pairs.count()


def search(index: TreapIndex, queries: DataFrame, query_key: str = "item_id", query_text: str = "text", key: str = "doc_id", counted: bool = False) -> DataFrame:
    """query_key, rank, key, score: the k best documents of each query; with ``counted`` also how many postings were scored for it in all segments."""
    config = index.config
    asked, blocks, n_terms = _query_blocks(index, queries, query_key, query_text, config)
    kind = next(f.dataType.elementType.simpleString() for f in index.segments.schema if f.name == "keys")
    small = n_terms <= config.broadcast_terms
    # a stated set of queries, in blocks, against all segments
    work = index.segments.crossJoin(F.broadcast(blocks) if small else blocks)
    arrow = pa.list_(pa.struct([("key", _arrow(index.segments, "keys")), ("score", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                segment = Segment(row)
                nums, found, reads = [], [], []
                for query in row.column("queries").flatten().to_pylist():
                    best, read = segment.search([p["term"] for p in query["pairs"]], [p["weight"] for p in query["pairs"]], config.k, config.narrow)
                    if best:
                        names = segment.keys.take(pa.array([d for _, d in best])).to_pylist()
                        nums.append(query["num"])
                        reads.append(read)
                        found.append([{"key": n, "score": s} for n, (s, _) in zip(names, best, strict=True)])
                yield pa.RecordBatch.from_pydict({"num": pa.array(nums, pa.int64()), "read": pa.array(reads, pa.int64()), "found": pa.array(found, arrow)})

    part = work.mapInArrow(run, f"num long, read long, found array<struct<key:{kind},score:long>>")
    if counted:
        part = materialize(part, "lexical-found")
    rows = part.select("num", F.explode("found").alias("f")).select("num", F.col("f.key").alias("__key"), F.col("f.score").alias("score"))
    order = [F.desc("score"), F.col("__key").isNull(), F.col("__key")]
    top = least_rows(rows, ["num"], order, config.k, "rank", F.xxhash64("__key", "score"))
    out = top.join(F.broadcast(asked) if small else asked, F.col("num") == F.col("__num"))
    if counted:
        out = out.join(part.groupBy("num").agg(F.sum("read").alias("postings_read")), "num")
    return out.select(query_key, "rank", F.col("__key").alias(key), "score", *(["postings_read"] if counted else []))


def _arrow(frame: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(next(f.dataType.elementType for f in frame.schema if f.name == column))
