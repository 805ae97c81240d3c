"""Substring deduplication over sliding sentence spans.

A text is cut after sentence ends and line ends.  A sentence of more than
``long_words`` words is cut on, at places that its content tells: after a word
whose hash says so, in pieces of at least ``least_words`` words, and after
``long_words`` where no word does.  Sentences and such pieces are the units
below.  Every run of ``run`` consecutive units with words is a span; a longer
run that repeats is covered by the spans inside it.  Spans are hashed over
their words (lower case, single spaces), joined over the whole corpus, and all
units covered by any span that is not the first of its hash are removed, with
wordless ones between them.  The first is the one with the least (doc_id, row,
unit).

The hash has 128 bits.  Its first half alone, map-side combined, tells which
spans can repeat at all; whether they are equal is decided by both halves,
which differ for any two spans of a corpus but for a chance of 10^-14 at 10^12
spans.

Defined results: a null or empty text has one empty unit and returns an
empty ``kept_text`` that is not null; texts of any length are read whole; texts
of fewer units with words than a run are kept whole; repeated rows are separate documents, of
which the first keeps its spans; of equal doc_ids the first row is the first; a
null doc_id comes last; an empty table gives no rows; columns other than
doc_id, text and the row number ``common.ROW`` are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, materialize, number_rows, skew_join, text_or_empty

#: Sentences keep their trailing white space, so joined together they are the text.
BOUNDARY = r"(?<=[.!?])(?=[\x20\x09])|(?<=\n)"


_CUT = re.compile(BOUNDARY)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class SpanConfig:
    run: int = 4  # consecutive units of a span
    long_words: int = 12  # words of a sentence beyond which it is cut on
    least_words: int = 4  # of a piece that its content ends
    cut_share: int = 4  # one word in so many ends a piece


def units(text: str, config: SpanConfig, known: dict[str, bool] | None = None) -> tuple[list[str], list[list[str]]]:
    """(the units of a text, which joined together are the text; the words of each, in lower case).  ``known`` remembers which words end a piece."""
    out, words = [], []
    known = {} if known is None else known
    for part in _CUT.split(text):
        found = _WORD.findall(part.lower())
        if len(found) <= config.long_words:
            out.append(part)
            words.append(found)
            continue
        places = [m.end() for m in _WORD.finditer(part)]
        first = at = 0
        for k, word in enumerate(found[:-1]):
            n = k + 1 - first
            if n < config.least_words:
                continue
            ends = known.get(word)
            if ends is None:
                ends = known[word] = xxhash.xxh3_64_intdigest(word) % config.cut_share == 0
            if ends or n == config.long_words:
                out.append(part[at : places[k]])
                words.append(found[first : k + 1])
                first, at = k + 1, places[k]
        out.append(part[at:])
        words.append(found[first:])
    return out, words


def spans_of(words: list[list[str]], run: int) -> list[tuple[int, int]]:
    """(first unit, last unit) of every run of units with words."""
    full = [k for k, w in enumerate(words) if w]
    return list(zip(full, full[run - 1 :], strict=False))


#: Words whose decision a task remembers at most; beyond them it begins again.
KNOWN_WORDS = 200_000


def _spans(config: SpanConfig):
    """A row for each span: doc_id, rid, h, g (the halves of its hash), i, j (first and last unit); and one with a null hash for each document, i its number of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                own, first, last, digests, sizes = [], [], [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    parts, words = units(text, config, known)
                    sizes.append(len(parts))
                    full = [k for k, w in enumerate(words) if w]
                    joined = [" ".join(words[k]) for k in full]
                    n = len(full) - config.run + 1
                    if n > 0:
                        own += [row] * n
                        first += full[:n]
                        last += full[config.run - 1 :]
                        digests += [xxhash.xxh3_128_digest(" ".join(joined[k : k + config.run])) for k in range(n)]
                halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
                none = pa.nulls(len(sizes), pa.int64())
                rows = pa.array(np.concatenate([np.array(own, dtype=np.int64), np.arange(len(sizes))]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows), part.column(1).take(rows), pa.concat_arrays([pa.array(halves[:, 0]), none]), pa.concat_arrays([pa.array(halves[:, 1]), none]),
                        pa.array(np.array(first + sizes, dtype=np.int32)), pa.array(np.array(last + sizes, dtype=np.int32)),
                    ],
                    ["doc_id", "rid", "h", "g", "i", "j"],
                )

    return run


def _kept(config: SpanConfig):
    """What is left of each text without its removed units; null for a null text."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, removed in batches:
            out = []
            for text, gone in zip(texts, removed, strict=True):
                drop = set() if gone is None else set(gone.tolist())
                out.append(None if text is None else "".join(p for k, p in enumerate(units(text, config)[0]) if k not in drop))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def dedup_spans(docs: DataFrame, config: SpanConfig = SpanConfig()) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (unit numbers), kept_text for every row; units are counted as sentences."""
    if ROW not in docs.columns:  # the texts are read again at the end: their numbers must not change
        docs = number_rows(docs.select("doc_id", "text"))
    rows = docs.select("doc_id", F.col(ROW).alias("rid"), text_or_empty().alias("text"))
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == "doc_id")
    written = materialize(rows.mapInArrow(_spans(config), f"doc_id {kind}, rid long, h long, g long, i int, j int"), "span-rows")
    spans, sizes = written.filter("h IS NOT NULL"), written.filter("h IS NULL").select("rid", F.col("i").alias("n"))
    # the hash alone first: only spans that occur again travel with their places
    counts = spans.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    total = spans.count()
    shared = materialize(skew_join(spans, counts, ["h"], "copies", total, ["rid", "i", "j"]).drop("copies"), "span-shared")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid", "i")
    groups = shared.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    again = skew_join(shared, groups, ["h", "g"], "copies", total, ["rid", "i", "j"])
    again = again.filter(~((F.col("rid") == F.col("first.rid")) & (F.col("i") == F.col("first.i"))))
    # a document's removed units: at most as many as it has
    gone = again.groupBy("rid").agg(F.collect_set(F.struct("i", "j")).alias("runs"))
    gone = gone.select("rid", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["j"]))))).alias("removed"))
    out = rows.join(sizes.join(gone, "rid", "left"), "rid")
    left = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_kept(config)(F.when(F.col("removed").isNotNull(), F.col("text")), F.col("removed")))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_sentences"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), left.alias("kept_text"))
