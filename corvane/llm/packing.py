"""Packing token sequences by non-negative least squares over length combinations.

Documents are cut at multiples of the window; what remains of each goes to a
class of its length, rounded up to ``grain``.  All combinations of at most
three classes that fill a window are enumerated, and how often to use each is
solved by non-negative least squares against the histogram of the classes.
The counts are rounded down and trimmed to what is there.  The pieces left
over are packed greedily: laid end to end and cut at the windows' ends.

Only the histogram comes to the driver; pieces find their window by their rank
in their class, a distributed prefix sum.

Defined results: a null text is empty; texts of any length are read whole, in
one row; every document has at least the end id; equal documents are packed each on its
own, and pieces of a class go to its windows in the order of their rows' hashes;
repeated rows are separate documents; an empty table gives no rows; columns
other than doc_id, text and the row number ``common.ROW`` are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cells_for, materialize, prefix_sum, row_id, text_or_empty


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str = ""  # path of a tokenizers file; every executor reads it there
    window: int = 2048
    grain: int = 16
    end_id: int = 1
    cache_words: int = 250_000  # per Python worker, some 50 MB


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {**{b: chr(b) for b in _PLAIN}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}}


class WordTokenizer:
    """The tokenizer's own ids, computed once per distinct word.

    White space separates words for this tokenizer, so a text's ids are those
    of its words in order.  Texts of letters whose normal form is their lower
    case skip the normaliser, and a full stop or comma after a letter becomes a
    word; any other text's words go through the whole tokenizer.  When the
    memory is full, words met once since the last time are forgotten.
    """

    PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*\Z")
    #: A full stop or comma after a letter and before white space or the end; its own character first, which is found fastest.
    STOP = re.compile(r"\.(?<=[a-zß-öø-ÿ]\.)(?=[\t\n\x0b\x0c\r ]|\Z)")
    COMMA = re.compile(r",(?<=[a-zß-öø-ÿ],)(?=[\t\n\x0b\x0c\r ]|\Z)")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
    #: Marks a word that goes through the whole tokenizer.
    WHOLE = "\x00"

    def __init__(self, path: str, cache_words: int) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.stop = self.bare.encode(".", add_special_tokens=False).ids
        self.most = cache_words
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.uses = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the words met more than once."""
        keep = np.flatnonzero(self.uses > 1)
        if 2 * len(keep) > self.most:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.most // 2]]
            keep.sort()
        names = list(self.place)
        lengths = (self.starts[1:] - self.starts[:-1])[keep]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.starts = np.concatenate([[0], ends])
        self.place = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.uses = np.ones(len(keep), dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        alone, rest = [], []
        for w in words:
            (alone if w.isalpha() else rest).append(w)
        cut = {w: self.PIECE.findall(w) for w in rest if w[0] != self.WHOLE}
        odd = [w for w in rest if w[0] == self.WHOLE]
        parts = list({p for ps in cut.values() for p in ps})
        pieces = {p: e.ids for p, e in zip(parts, self.bare.encode_batch_fast(self._bytes(parts), add_special_tokens=False), strict=True)}
        ids = [list(chain.from_iterable(map(pieces.__getitem__, ps))) for ps in cut.values()]
        ids += [e.ids for e in self.full.encode_batch_fast([w[1:] for w in odd], add_special_tokens=False)]
        words = [*alone, *cut, *odd]
        first = len(self.starts) - 1
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        flat, sizes = self._letters(alone)
        lengths = np.concatenate([sizes, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])
        more = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths[len(sizes) :].sum()))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, flat, more])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    @staticmethod
    def _bytes(words: list[str]) -> list[str]:
        """Words in the byte-level alphabet."""
        return [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE) for w in words]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters one after the other, and how many each has: many words at a time, a full stop, which no such word has, after each."""
        coded = self._bytes(words)
        texts = [" . ".join(coded[i : i + 1_000]) + " ." for i in range(0, len(coded), 1_000)]
        some = (self.bare.encode_batch_fast(texts[i : i + 8], add_special_tokens=False) for i in range(0, len(texts), 8))  # their encodings are large
        flat = np.fromiter(chain.from_iterable(e.ids for own in some for e in own), dtype=np.uint32)
        ends = np.flatnonzero(flat == self.stop[0])
        if len(self.stop) != 1 or len(ends) != len(words):  # a vocabulary in which that is not so
            ids = [e.ids for e in self.bare.encode_batch_fast(coded, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return flat[flat != self.stop[0]], np.diff(ends, prepend=-1) - 1

    def _words(self, text: str) -> list[str]:
        if self.PLAIN.match(text) and not any(s in text for s in self.special):
            return self.COMMA.sub(" ,", self.STOP.sub(" .", text.lower())).split()
        return [self.WHOLE + w for w in self.SPACE.split(text) if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.most:
            self._forget()
        words = [self._words(t) for t in texts]
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = list(chain.from_iterable(words))
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = list(map(flat.__getitem__, missing.tolist()))
            self._learn(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.place.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words_end = np.cumsum(counts)
        id_end = np.concatenate([[0], ends])[words_end] if len(words_end) else words_end
        return np.split(ids, id_end[:-1])


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}
#: Characters of text that one call of the tokenizer gets at most, but for a longer text alone.
SLICE_CHARS = 1_000_000


def tokenizer_for(path: str, cache_words: int) -> WordTokenizer:
    key = (path, cache_words)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the tokenizer's own threads wait for work busily
        _TOKENIZERS[key] = WordTokenizer(path, cache_words)
    return _TOKENIZERS[key]


def _tokenize(config: PackConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_for(config.tokenizer or default_tokenizer(), config.cache_words)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                    chars += len(texts[end])
                    end += 1
                ids = [np.append(x, np.uint32(config.end_id)).astype("<u4") for x in tok.encode(texts[at:end])]
                part = batch.slice(at, end - at)
                narrow = [x.astype("<u2").tobytes() if x.max() < 65_536 else b"" for x in ids]
                wide = [None if n else x.tobytes() for x, n in zip(ids, narrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([n or None for n in narrow], pa.binary()), pa.array(wide, pa.binary())], names=["rid", "doc_id", "doc_tokens", "ids16", "ids32"])
                at = end

    return run


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Least squares with x >= 0 by active sets: variables enter by the largest gradient and leave when negative."""
    gram, rhs = a.T @ a, a.T @ b
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(3 * n):
        grad = rhs - gram @ x
        grad[active] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol * max(1.0, float(np.abs(rhs).max())):
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(gram[np.ix_(on, on)], rhs[on], rcond=None)[0]
            bad = on[z[on] <= 1e-12]
            if not len(bad):
                x = z
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0.0
    return x


def combinations(classes: list[int], units: int) -> list[tuple[int, ...]]:
    """Every multiset of at most three of the classes that adds up to ``units``, as a descending tuple."""
    have = set(classes)
    out = [(units,)] if units in have else []
    out += [(units - c, c) for c in classes if units - c >= c and units - c in have]
    for small in classes:
        for mid in (c for c in classes if c >= small):
            top = units - small - mid
            if top < mid:
                break
            if top in have:
                out.append((top, mid, small))
    return out


def solve_plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, times), never using more pieces of a class than there are."""
    classes = sorted(histogram)
    combos = combinations(classes, units)
    if not combos:
        return []
    index = {c: i for i, c in enumerate(classes)}
    a = np.zeros((len(classes), len(combos)))
    for j, combo in enumerate(combos):
        for c in combo:
            a[index[c], j] += 1
    total = float(sum(histogram.values()))
    weight = np.sqrt(np.array(classes, dtype=float))  # an unpacked long piece costs more than a short one
    times = nnls(a * weight[:, None], np.array([histogram[c] / total for c in classes]) * weight) * total
    left, plan = dict(histogram), []
    for j in np.argsort(-times, kind="stable"):
        combo = combos[int(j)]
        need = {c: combo.count(c) for c in combo}
        n = min([int(times[j] + 0.5), *(left[c] // k for c, k in need.items())])
        if n > 0:
            plan.append((combo, n))
            for c, k in need.items():
                left[c] -= n * k
    return plan


def plan_ranges(plan: list[tuple[tuple[int, ...], int]], first: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (class, rank from, rank to, sequence id of the first, slot) and the next free sequence id."""
    used: dict[int, int] = {}
    rows = []
    for combo, n in plan:
        for slot, c in enumerate(combo):
            start = used.get(c, 0)
            rows.append((c, start, start + n, first, slot))
            used[c] = start + n
        first += n
    return rows, first


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            n16 = get["ids16"][i].as_buffer() if get["ids16"][i].is_valid else None
            ids = np.frombuffer(n16, "<u2").astype("<u4") if n16 is not None else np.frombuffer(get["ids32"][i].as_buffer(), "<u4")
            doc = get["doc_id"][i].as_py()
            for p in get["pieces"][i].as_py():
                cut = ids[p["start"] : p["start"] + p["length"]]
                for c, v in zip(cols, (doc, p["start"], p["length"], zlib.crc32(cut.tobytes()), len(ids), p["sequence_id"], p["offset"]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], get["doc_id"].type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)


def pack(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, window, grain = docs.sparkSession, config.window, config.grain
    assert window % grain == 0, "the grain must divide the window"
    rows = docs.select(row_id(docs).alias("rid"), "doc_id", text_or_empty().alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    tokens = materialize(rows.mapInArrow(_tokenize(config), f"rid long, doc_id {id_type}, doc_tokens long, ids16 binary, ids32 binary"), "pack-tokens")
    sizes = tokens.select("rid", "doc_tokens")
    n = F.col("doc_tokens")
    rest = sizes.withColumn("length", F.pmod(n, F.lit(window))).filter("length > 0").withColumn("start", n - F.col("length"))
    rest = rest.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {int(r["class"]): int(r["n"]) for r in rest.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # window / grain rows at most
    full, n_docs = (int(x or 0) for x in sizes.agg(F.sum(F.floor(n / window)), F.count(F.lit(1))).first())
    cells = cells_for(n_docs)
    ranges, first = plan_ranges(solve_plan(histogram, window // grain), 0)
    # whole windows are sequences of one piece
    whole = prefix_sum(sizes.filter(n >= window).withColumn("k", F.lit(0)), ["k"], ["rid"], F.floor(n / window), "seq0", cells)
    whole = whole.select("rid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / window) - 1)).alias("i"), "seq0")
    whole = whole.select("rid", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("seq0") + F.col("i") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = prefix_sum(rest, ["class"], ["rid"], F.lit(1), "rank", max(1, cells // 8))
    plan = spark.createDataFrame(ranges, "pclass int, lo long, hi long, seq0 long, slot int")  # bounded by the number of combinations
    ranked = ranked.join(F.broadcast(plan), (F.col("class") == F.col("pclass")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    ranked = materialize(ranked.select("rid", "start", "length", (F.col("seq0") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot"), "pack-ranked")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = ranked.filter("sequence_id IS NOT NULL").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # the rest end to end, cut at the ends of the windows
    stream = prefix_sum(ranked.filter("sequence_id IS NULL").withColumn("k", F.lit(0)), ["k"], ["rid"], F.col("length"), "at", cells)
    lo, hi = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    stream = stream.withColumn("w", F.explode(F.sequence(lo, hi)))
    begin, end = F.greatest(F.col("at"), F.col("w") * window), F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * window)
    stream = stream.select("rid", (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), (F.col("w") + first + full).alias("sequence_id"), (begin - F.col("w") * window).alias("offset"))
    cols = ["rid", "start", "length", "sequence_id", "offset"]
    pieces = whole.select(cols).unionByName(combined.select(cols)).unionByName(stream.select(cols))
    # a document has one piece per window of its own length and two more at most
    by_doc = pieces.groupBy("rid").agg(F.collect_list(F.struct(*cols[1:])).alias("pieces"))
    joined = tokens.join(by_doc, "rid").select("doc_id", "ids16", "ids32", "pieces")
    return joined.mapInArrow(_checksums, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
