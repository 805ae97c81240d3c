"""Substring deduplication with a logarithmic family of suffix arrays.

A byte goes when a run of ``length`` bytes that covers it also starts in a
document with a smaller doc_id.  Suffixes are told apart by their first
``length`` bytes, so the family is partitioned by content: every window of
``length`` bytes belongs to the partition of its minimizer (the least hash of
the k-byte words in it), and equal windows meet wherever they occur.

Three passes over the documents, cut into chunks of consecutive rows by their
bytes, the same way each time:

1. each chunk sends the distinct minimizers of its windows, five bytes each;
   those that occur once in the corpus are of no further interest.  The buckets
   they go to are of a fixed size, and no fewer than ``least_buckets``;
2. each chunk sends the stretches of text under its repeated minimizers, a row
   for each different one, with the least doc_id;
3. in every partition the stretches come in order of doc_id, batch by batch.
   A batch gets a suffix array, the positions of its windows in order of their
   bytes.  It is merge-scanned against the arrays of the existing levels:
   neighbours whose common prefix has ``length`` bytes are a match.  Then it
   becomes a level itself, and levels of about equal size are merged, linearly.
   The answer, a bit for each window, goes back to the chunk, which removes bytes.

A minimizer of over ``split_runs`` stretches does not stay in one partition: its
stretches are cut in two, windows with more text after the minimizer's word and
those with more before it, and are dealt by the eight bytes on that side.
A chunk sends a stretch once, so there are no more copies of one than chunks;
where there are over ``hot_copies`` chunks, the copies of such stretches meet
by a map-side-combined minimum first.

``add_batch`` keeps the family: levels are stored, and a later batch of
documents is scanned against all earlier ones and joins them.  An index holds
every window, as a later batch may repeat any.

Defined results: null is the empty text; texts under ``length`` bytes stay
whole, texts of any length are read whole; rows with equal doc_id never remove
each other's bytes, so repeated rows lose the same; a null doc_id counts as the
largest; doc_id may be of any integer type, or of a string, date or timestamp
type, which is ordered by dense rank; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, materialize, number_rows, skew_join, text_or_empty

NO_ID = (1 << 63) - 1
KMER = 24
#: Bytes before or after a hot minimizer's word that its stretches are dealt by.
SIDE = 8
STRETCH = 64  # windows: an answer is one long


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 50
    chunk_bytes: int = 2 << 20
    bucket_keys: int = 1 << 22  # minimizers that one bucket of pass 1 aims at
    least_buckets: int = 64
    partition_bytes: int = 1 << 20  # of the input's text, for each partition of the family
    batch_windows: int = 1 << 16
    split_runs: int = 1 << 15
    hot_copies: int = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number."""
    x = data.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the k-byte word at every position."""
    x = _eights(data)
    return _mix(x[:-16] * np.uint64(0x9E3779B97F4A7C15) + x[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + x[16:] * np.uint64(0x165667B19E3779F9))


def minimizers(data: np.ndarray, length: int, step: int = 1 << 18) -> np.ndarray:
    """The least k-byte word hash in each window of ``length`` bytes, for all len(data) - length + 1 windows."""
    n, span = max(0, len(data) - length + 1), length - KMER + 1
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, step):
        end = min(n, at + step)
        h = word_hashes(data[at : end + length - 1])
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        out[at:end] = h[: end - at]
    return out


class Chunk:
    """The documents of one chunk, and the runs of windows that share a minimizer."""

    def __init__(self, table: pa.Table, config: SuffixConfig) -> None:
        self.length = config.length
        table = table.select(["doc_id", "at", "text"]).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("at", "ascending"), ("text", "ascending")])).combine_chunks()
        self.ids = table["doc_id"]
        self.order = table["at"].to_numpy()
        raw = [t.encode() for t in table["text"].to_pylist()]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.bytes = b"".join(raw)
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        least = minimizers(self.data, config.length)
        doc = np.repeat(np.arange(len(raw), dtype=np.int32), self.sizes)[: len(least)]
        inside = np.arange(len(least)) + config.length <= self.ends[doc] if len(least) else np.zeros(0, dtype=bool)
        # runs of windows of one document with one minimizer, none longer than the limit
        new = np.ones(len(least), dtype=bool)
        if len(least) > 1:
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(least)))
        if len(begin) and int(size.max()) > STRETCH:
            long = size > STRETCH
            extra = np.concatenate([np.arange(b + STRETCH, b + s, STRETCH) for b, s in zip(begin[long], size[long], strict=True)])
            begin = np.sort(np.concatenate([begin, extra]))
        # a run ends where its document's windows end
        stop = np.append(begin[1:], len(least))
        ok = inside[begin] if len(begin) else np.zeros(0, dtype=bool)
        begin, stop = begin[ok], stop[ok]
        self.run_doc = doc[begin]
        self.run_start = begin
        self.run_windows = np.minimum(stop, self.ends[self.run_doc] - config.length + 1) - begin if len(begin) else begin
        self.run_least = least[begin]
        self.key = _mix(self.run_least ^ np.uint64(0x5851F42D4C957F2D))
        self.keys, self.key_of, self.key_runs = np.unique(self.key, return_inverse=True, return_counts=True)
        # whether two documents of the chunk with different doc_id share the minimizer
        low = np.full(len(self.keys), NO_ID)
        high = np.full(len(self.keys), -NO_ID)
        np.minimum.at(low, self.key_of, self.order[self.run_doc])
        np.maximum.at(high, self.key_of, self.order[self.run_doc])
        self.shared = low < high

    def by_bucket(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, numbers of its keys in ascending order)"""
        b = (self.keys % np.uint64(buckets)).astype(np.int64)
        at = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.diff(b[at])) + 1
        return [(int(b[x[0]]), x) for x in np.split(at, cut) if len(x)]

    def stretches(self, repeated: np.ndarray, hot: np.ndarray) -> Stretches:
        """The stretches under repeated keys; equal ones of the chunk are one, with the least doc_id."""
        runs = np.flatnonzero(repeated[self.key_of])
        is_hot = hot[self.key_of[runs]]
        cold = runs[~is_hot]
        start, windows, doc, key = self.run_start[cold], self.run_windows[cold], self.run_doc[cold], self.key[cold]
        cut = [self._cut(int(r)) for r in runs[is_hot].tolist()]
        if cut:
            more = [np.concatenate(x) for x in zip(*cut, strict=True)]
            start, windows, doc, key = (np.concatenate([a, b]) for a, b in zip((start, windows, doc, key), more, strict=True))
        first_hot = len(cold)
        tail = self.length - 1
        place: dict[bytes, int] = {}
        get = place.setdefault
        data = self.bytes
        of = np.array([get(data[s:e], len(place)) for s, e in zip(start.tolist(), (start + windows + tail).tolist(), strict=True)], dtype=np.int64)
        first = np.full(len(place), len(of), dtype=np.int64)
        np.minimum.at(first, of, np.arange(len(of)))
        least = np.full(len(place), NO_ID)
        order = self.order[doc]
        np.minimum.at(least, of, order)
        return Stretches(list(place), least, key[first], first >= first_hot, start, windows, order, of)

    def _cut(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A hot run's windows, cut where the side that they are dealt by changes: starts, windows, documents, keys."""
        s, w = int(self.run_start[r]), int(self.run_windows[r])
        span = self.length - KMER + 1
        words = np.flatnonzero(word_hashes(self.data[s : s + w + self.length - 1]) == self.run_least[r])
        anchor = words[np.searchsorted(words, np.arange(w))]  # a window's word is the first of the least hash in it
        after = anchor - np.arange(w) <= span // 2
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (after[1:] != after[:-1])))
        size = np.diff(np.append(new, w))
        at = s + anchor[new] + np.where(after[new], KMER, -SIDE)
        side = np.array([int.from_bytes(self.bytes[a : a + SIDE], "big") for a in at.tolist()], dtype=np.uint64)
        key = _mix(self.key[r] ^ _mix(side + after[new].astype(np.uint64)))
        return s + new, size, np.full(len(new), self.run_doc[r]), key


@dataclass
class Stretches:
    text: list[bytes]
    least: np.ndarray  # doc_id order of the first document with it
    key: np.ndarray
    hot: np.ndarray
    start: np.ndarray  # of every occurrence in the chunk: position, windows, doc_id order, number of the stretch
    windows: np.ndarray
    order: np.ndarray
    of: np.ndarray


_KEYS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("shared", pa.binary())])


def _numbered(batch: pa.RecordBatch, before: int, config: SuffixConfig) -> tuple[np.ndarray, int]:
    """The chunk of each row: a new one begins after every ``chunk_bytes`` of a partition's text; and the bytes so far."""
    ends = before + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[before], ends[:-1]])
    return (TaskContext.get().partitionId() << 32) + starts // config.chunk_bytes, int(ends[-1])


def _deal(config: SuffixConfig):
    """The rows with their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            if batch.num_rows:
                chunk, size = _numbered(batch, size, config)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk)], names=[*batch.schema.names, "chunk"])

    return run


def _send_keys(config: SuffixConfig, buckets: int):
    def send(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        chunk = Chunk(pa.Table.from_batches(batches), config)
        rows = chunk.by_bucket(buckets)
        # forty bits of a key beside its bucket; a collision only costs work
        cut = [((chunk.keys[x] // np.uint64(buckets)) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for _, x in rows]
        runs = [np.minimum(chunk.key_runs[x], 65_535).astype("<u2").tobytes() for _, x in rows]
        shared = [np.packbits(chunk.shared[x]).tobytes() for _, x in rows]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in (cut, runs, shared)]], schema=_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, number = 0, [], -1
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, size = _numbered(batch, size, config)
            cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held and int(chunk[a]) != number:
                    yield send(held, number)
                    held = []
                number = int(chunk[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield send(held, number)

    return run


def _find_repeated(config: SuffixConfig):
    def run(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table["keys"]]
        counts = [len(b) // 5 for b in blobs]
        wide = np.zeros((sum(counts), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 5)
        _, of, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        shared = np.concatenate([np.unpackbits(np.frombuffer(s.as_py(), dtype=np.uint8), count=n) for s, n in zip(table["shared"], counts, strict=True)]).astype(bool)
        total = np.bincount(of, weights=np.frombuffer(b"".join(x.as_py() for x in table["runs"]), dtype="<u2"))
        again = (times[of] > 1) | shared
        hot = again & (total[of] > config.split_runs)
        ends = np.cumsum(counts)[:-1]
        pack = lambda bits: pa.array([np.packbits(p).tobytes() for p in np.split(bits, ends)], pa.binary())
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "mask": pack(again), "hot": pack(hot)})

    return run


def _bits(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=count).astype(bool)


def _known(chunk: Chunk, masks: dict[int, tuple[bytes, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are repeated, and which are hot."""
    again, hot = np.zeros(len(chunk.keys), dtype=bool), np.zeros(len(chunk.keys), dtype=bool)
    for b, at in chunk.by_bucket(buckets):
        again[at], hot[at] = (_bits(m, len(at)) for m in masks[b])
    return again, hot


_STRETCH = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("no", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()), ("piece", pa.binary())])
_STRETCH_DDL = "part long, chunk long, no long, hot boolean, doc long, piece binary"


def _send_stretches(config: SuffixConfig, buckets: int, parts: int, combine: bool = False):
    """Rows of stretches; with no buckets, of all windows."""

    def rows(chunk: Chunk, number: int, again: np.ndarray, hot: np.ndarray) -> pa.Table:
        own = chunk.stretches(again, hot)
        part = ((own.key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        n = len(own.text)
        return pa.table([pa.array(part), pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(own.hot & combine), pa.array(own.least), pa.array(own.text, pa.binary())], schema=_STRETCH)

    def run(docs: pa.Table, masks: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _STRETCH.empty_table()
        chunk = Chunk(docs, config)
        mask = {b.as_py(): (m.as_py(), h.as_py()) for b, m, h in zip(masks["bucket"], masks["mask"], masks["hot"], strict=True)}
        return rows(chunk, docs["chunk"][0].as_py(), *_known(chunk, mask, buckets))

    def run_all(docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, config)
        return rows(chunk, docs["chunk"][0].as_py(), np.ones(len(chunk.keys), dtype=bool), np.zeros(len(chunk.keys), dtype=bool))

    return run if buckets else run_all


@dataclass
class Level:
    """A suffix array: positions in a text, in order of the ``length`` bytes there, all different, and the least doc_id of each."""

    text: bytes
    at: np.ndarray
    docs: np.ndarray


class SuffixFamily:
    """Levels of suffix arrays of geometrically growing sizes."""

    def __init__(self, length: int, levels: list[Level] | None = None) -> None:
        self.length = length
        self.levels = levels or []

    def words(self, text: bytes, at: np.ndarray) -> list[np.ndarray]:
        """The bytes at the positions as numbers of eight bytes, the most significant first."""
        eights = _eights(np.frombuffer(text + bytes(16), dtype=np.uint8))
        out = []
        for j in range(0, self.length, 8):
            w = eights[at + j]
            out.append(w if j + 8 <= self.length else w >> np.uint64(8 * (j + 8 - self.length)))
        return out

    @staticmethod
    def sort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Order of the windows, and which of them, in that order, differ from the one before.

        Ascending runs are merged in linear time, so two sorted arrays one after the other are merged, not sorted.
        """
        n = len(words[0])
        order = np.argsort(words[0], kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = words[0][order[1:]] != words[0][order[:-1]]
        for w in words[1:]:
            # places of windows that agree with a neighbour so far
            tied = ~new
            tied[:-1] |= ~new[1:]
            place = np.flatnonzero(tied)
            if not len(place):
                break
            group = np.cumsum(new[place])
            sub = order[place]
            value = w[sub]
            if ((value[1:] < value[:-1]) & (group[1:] == group[:-1])).any():
                again = np.lexsort((value, group))
                sub, value = sub[again], value[again]
                order[place] = sub
            new[place[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        return order, new

    def add(self, text: bytes, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Insert a batch, no doc_id of which is below those inserted before; which of its windows start in a document before theirs."""
        if not len(at):
            return np.zeros(0, dtype=bool)
        order, new = self.sort(self.words(text, at))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[order], first)
        level = Level(text, at[order[first]], least)
        known, own = least.copy(), self.words(text, level.at)
        for old in self.levels:
            both = [np.concatenate([a, b]) for a, b in zip(self.words(old.text, old.at), own, strict=True)]
            scan, differs = self.sort(both)
            hit = np.flatnonzero(~differs)  # the whole length in common with the one before, which is the old one
            mine = scan[hit] - len(old.at)
            known[mine] = np.minimum(known[mine], old.docs[scan[hit - 1]])
        out = np.empty(len(at), dtype=bool)
        out[order] = known[group] < docs[order]
        self._push(level)
        return out

    def _push(self, level: Level) -> None:
        while self.levels and len(self.levels[-1].at) <= 2 * len(level.at):
            old = self.levels.pop()
            both = [np.concatenate([a, b]) for a, b in zip(self.words(old.text, old.at), self.words(level.text, level.at), strict=True)]
            order, new = self.sort(both)
            first = np.flatnonzero(new)
            at, docs = np.concatenate([old.at, level.at + len(old.text)])[order], np.concatenate([old.docs, level.docs])[order]
            level = Level(old.text + level.text, at[first], np.minimum.reduceat(docs, first))
        self.levels.append(level)


def _scan(family: SuffixFamily, text: list[bytes], least: np.ndarray, batch_windows: int) -> np.ndarray:
    """For every different stretch, a bit for each of its windows that starts in a document before the stretch's own."""
    masks = np.zeros(len(text), dtype=np.uint64)
    order = np.argsort(least, kind="stable")
    size = np.array([len(x) for x in text], dtype=np.int64)
    counts = size - family.length + 1
    batch = (np.cumsum(counts[order]) - 1) // batch_windows
    for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1) if len(order) else []:
        n = counts[own]
        first = np.cumsum(n) - n
        offset = np.arange(int(n.sum())) - np.repeat(first, n)
        starts = np.repeat(np.cumsum(size[own]) - size[own], n) + offset
        found = family.add(b"".join([text[i] for i in own.tolist()]), starts, np.repeat(least[own], n))
        masks[own] = np.bitwise_or.reduceat(found.astype(np.uint64) << offset.astype(np.uint64), first)
    return masks


_ANSWER = pa.schema([("chunk", pa.int64()), ("no", pa.int64()), ("bits", pa.int64()), ("blob", pa.binary()), ("blob2", pa.binary())])
_ANSWER_DDL = "chunk long, no long, bits long, blob binary, blob2 binary"


def _different(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different stretches, the least document of each, and per row its document and the number of its stretch."""
    place: dict[bytes, int] = {}
    get = place.setdefault
    of = np.array([get(p, len(place)) for p in table["piece"].to_pylist()], dtype=np.int64)
    docs = table["doc"].to_numpy()
    least = np.full(len(place), NO_ID)
    np.minimum.at(least, of, docs)
    return list(place), least, docs, of


def _row_masks(text: list[bytes], least: np.ndarray, masks: np.ndarray, docs: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
    """A stretch that an earlier document has too goes whole."""
    windows = np.array([len(x) for x in text], dtype=np.uint64) - np.uint64(length - 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - windows)
    return np.where(docs > least[of], full[of], masks[of])


def _answers(chunk: pa.Array, no: pa.Array, masks: np.ndarray) -> pa.Table:
    some = pa.array(np.flatnonzero(masks))
    none = pa.nulls(len(some), pa.binary())
    return pa.table([chunk.take(some), no.take(some), pa.array(masks.view(np.int64)).take(some), none, none], schema=_ANSWER)


def _answer(config: SuffixConfig):
    def run(table: pa.Table) -> pa.Table:
        text, least, docs, of = _different(table)
        masks = _scan(SuffixFamily(config.length), text, least, config.batch_windows)
        return _answers(table["chunk"].combine_chunks(), table["no"].combine_chunks(), _row_masks(text, least, masks, docs, of, config.length))

    return run


def _answer_pieces(config: SuffixConfig):
    def run(table: pa.Table) -> pa.Table:
        text, least, _, _ = _different(table)
        masks = _scan(SuffixFamily(config.length), text, least, config.batch_windows)
        return pa.table({"piece": pa.array(text, pa.binary()), "bits": pa.array(masks.view(np.int64))})

    return run


def _gather(chunk: Chunk, own: Stretches, no: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk go."""
    masks = np.zeros(len(own.text), dtype=np.uint64)
    masks[no] = bits.view(np.uint64)
    windows = own.windows.astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - windows) if len(windows) else windows
    of_run = np.where(own.order > own.least[own.of], full, masks[own.of])
    edge = np.zeros(len(chunk.bytes) + 1, dtype=np.int32)
    some = np.flatnonzero(of_run)
    of_run, start = of_run[some], own.start[some]
    for b in range(STRETCH):
        hit = start[(of_run >> np.uint64(b)) & np.uint64(1) == 1] + b  # every window starts at a place of its own
        edge[hit] += 1
        edge[hit + chunk.length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _remove(config: SuffixConfig, buckets: int, id_type: pa.DataType, with_text: bool):
    schema = pa.schema([("doc_id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text else []))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        chunk = Chunk(docs, config)
        no, bits = (answers[c].to_numpy() for c in ("no", "bits"))
        if buckets:
            note = answers.filter(pc.less(answers["no"], 0))
            mask = {-1 - b.as_py(): (m.as_py(), h.as_py()) for b, m, h in zip(note["no"], note["blob"], note["blob2"], strict=True)}
            again, hot = _known(chunk, mask, buckets)
        else:
            again, hot = np.ones(len(chunk.keys), dtype=bool), np.zeros(len(chunk.keys), dtype=bool)
        gone = _gather(chunk, chunk.stretches(again, hot), no[no >= 0], bits[no >= 0])
        out: list[tuple] = []
        for s, e in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            g = gone[s:e]
            if g.any():
                kept = chunk.data[s:e][~g].tobytes()
                out.append((e - s, e - s - len(kept), int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(g[0])), hashlib.sha256(kept).hexdigest(), kept))
            else:
                kept = chunk.bytes[s:e]
                out.append((e - s, 0, 0, hashlib.sha256(kept).hexdigest(), kept))
        ids = chunk.ids.combine_chunks() if isinstance(chunk.ids, pa.ChunkedArray) else chunk.ids
        cols = [ids.cast(id_type), *[pa.array([o[i] for o in out], schema.field(i + 1).type) for i in range(5 if with_text else 4)]]
        return pa.table(cols, schema=schema)

    return run


_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "date": pa.date32(), "timestamp": pa.timestamp("us", tz="UTC"), "timestamp_ntz": pa.timestamp("us")}


def _ordered(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, at (its order as a long) and text of every row, and doc_id's type."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in _ID_TYPES:
        raise TypeError(f"doc_id of type {kind} has no order here")
    text = text_or_empty().alias("text")
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at"), text), kind
    # any other order by numbers of the sorted, different ids, which no single task sorts
    ids = number_rows(docs.select(F.col("doc_id").alias("known")).filter("known IS NOT NULL").distinct().repartitionByRange("known").sortWithinPartitions("known"))
    ids = ids.withColumnRenamed(ROW, "at")
    joined = docs.select("doc_id", text).join(ids, F.col("doc_id") == F.col("known"), "left")
    return materialize(joined.select("doc_id", F.coalesce("at", F.lit(NO_ID)).alias("at"), "text"), "suffix-rows"), kind


def _columns(kind: str, with_text: bool) -> str:
    return f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")


def remove_repeated(docs: DataFrame, config: SuffixConfig = SuffixConfig(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, on request) for every row.

    ``docs`` is read twice and must be repeatable, the order of its rows included, as a table's scan is.
    """
    rows, kind = _ordered(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(config.least_buckets, math.ceil(total / 14 / config.bucket_keys))
    parts = max(8, math.ceil(total / config.partition_bytes))
    keys = rows.mapInArrow(_send_keys(config, buckets), "bucket long, chunk long, keys binary, runs binary, shared binary")
    masks = materialize(keys.groupBy("bucket").applyInArrow(_find_repeated(config), "chunk long, bucket long, mask binary, hot binary"), "suffix-masks")
    combine = total > config.hot_copies * config.chunk_bytes and not masks.filter(F.hex("hot").rlike("[1-9A-F]")).isEmpty()
    # one exchange of the texts by chunk, used by both passes
    dealt = rows.mapInArrow(_deal(config), f"doc_id {kind}, at long, text string, chunk long")
    pieces = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(_send_stretches(config, buckets, parts, combine), _STRETCH_DDL)
    if combine:
        pieces = materialize(pieces, "suffix-pieces", ("hot",))
    answers = (pieces.filter("NOT hot") if combine else pieces).groupBy("part").applyInArrow(_answer(config), _ANSWER_DDL)
    if combine:
        hot = pieces.filter("hot")
        least = materialize(hot.groupBy("part", "piece").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies")), "suffix-hot")
        found = least.select("part", "doc", "piece").groupBy("part").applyInArrow(_answer_pieces(config), "piece binary, bits long")
        known = least.select("piece", "copies", F.col("doc").alias("first")).join(found, "piece")
        back = skew_join(hot.select("chunk", "no", "doc", "piece"), known, ["piece"], "copies", hot.count(), ["chunk", "no"])
        windows = F.octet_length("piece") - (config.length - 1)
        bits = F.when(F.col("doc") > F.col("first"), F.when(windows >= 64, F.lit(-1)).otherwise(F.expr(f"shiftleft(1L, octet_length(piece) - {config.length - 1}) - 1"))).otherwise(F.col("bits"))
        none = F.lit(None).cast("binary")
        answers = answers.unionByName(back.select("chunk", "no", bits.cast("long").alias("bits"), none.alias("blob"), none.alias("blob2")))
    note = masks.select("chunk", (-1 - F.col("bucket")).alias("no"), F.lit(0).cast("long").alias("bits"), F.col("mask").alias("blob"), F.col("hot").alias("blob2"))
    heard = answers.unionByName(note).groupBy("chunk")
    return dealt.groupBy("chunk").cogroup(heard).applyInArrow(_remove(config, buckets, _ID_TYPES[kind], with_text), _columns(kind, with_text))


# ---- an index that takes batch after batch

_LEVEL_DDL = "part long, level int, text binary, at binary, docs binary"
_ADDED_DDL = "chunk long, no long, bits long, part long, level int, text binary, at binary, docs binary"


def _extend(config: SuffixConfig):
    schema = pa.schema([("chunk", pa.int64()), ("no", pa.int64()), ("bits", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("text", pa.binary()), ("at", pa.binary()), ("docs", pa.binary())])

    def run(pieces: pa.Table, stored: pa.Table) -> pa.Table:
        rows = sorted(stored.to_pylist(), key=lambda r: r["level"])
        family = SuffixFamily(config.length, [Level(r["text"], np.frombuffer(r["at"], "<i8"), np.frombuffer(r["docs"], "<i8")) for r in rows])
        part = (pieces if pieces.num_rows else stored)["part"][0].as_py()
        out = [_ANSWER.empty_table()]
        if pieces.num_rows:
            text, least, docs, of = _different(pieces)
            masks = _scan(family, text, least, config.batch_windows)
            out.append(_answers(pieces["chunk"].combine_chunks(), pieces["no"].combine_chunks(), _row_masks(text, least, masks, docs, of, config.length)))
        answers = pa.concat_tables(out).select(["chunk", "no", "bits"])
        levels = pa.table({"part": pa.array([part] * len(family.levels), pa.int64()), "level": pa.array(range(len(family.levels)), pa.int32()), "text": pa.array([x.text for x in family.levels], pa.binary()), "at": pa.array([x.at.astype("<i8").tobytes() for x in family.levels], pa.binary()), "docs": pa.array([x.docs.astype("<i8").tobytes() for x in family.levels], pa.binary())})
        return pa.concat_tables([answers, levels], promote_options="default").select(schema.names).cast(schema)

    return run


def add_batch(docs: DataFrame, index: str, config: SuffixConfig = SuffixConfig(), parts: int = 64, with_text: bool = False) -> DataFrame:
    """``remove_repeated`` for a batch of documents after all those that ``index`` has, which it then has too.

    ``index`` is a folder that all executors share; it holds a generation of
    levels for each batch.  doc_ids are integers, none below those added
    before.  ``parts``, the partitions of the family, are those of the first
    batch for good: size them for the index to come.  A batch that fails leaves
    the last complete generation in force.
    """
    spark = docs.sparkSession
    rows, kind = _ordered(docs)
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("an index needs integer doc_ids")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName().split("=")[1]) for s in (system.listStatus(path) if system.exists(path) else []) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if done:
        stored = spark.read.schema(_LEVEL_DDL).parquet(f"{index}/generation={done[-1]}")
        parts = int(stored.filter("part < 0").first()["level"])
        stored = stored.filter("part >= 0")
    else:
        stored = spark.createDataFrame([], _LEVEL_DDL)
    dealt = materialize(rows.mapInArrow(_deal(config), f"doc_id {kind}, at long, text string, chunk long"), "suffix-batch")
    pieces = dealt.groupBy("chunk").applyInArrow(_send_stretches(config, 0, parts), _STRETCH_DDL)
    out = materialize(pieces.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(_extend(config), _ADDED_DDL), "suffix-added")
    head = spark.createDataFrame([(-1, parts, None, None, None)], _LEVEL_DDL)
    levels = out.filter("level IS NOT NULL").select("part", "level", "text", "at", "docs").unionByName(head)
    levels.write.mode("overwrite").parquet(f"{index}/generation={(done[-1] if done else -1) + 1}")
    none = F.lit(None).cast("binary")
    answers = out.filter("level IS NULL").select("chunk", "no", "bits", none.alias("blob"), none.alias("blob2"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(config, 0, _ID_TYPES[kind], with_text), _columns(kind, with_text))
