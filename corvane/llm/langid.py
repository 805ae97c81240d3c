"""Language identification by compression.

Each language has a zstandard raw-content dictionary, made of a bounded sample
of labelled texts.  Texts are lower-cased and everything but letters becomes single
spaces.  A text is cut into segments, every segment is compressed with every
dictionary, and the language with the least total size wins; the whole text is
always used.  A narrow margin over the second language rejects.

Sizes are whole bytes, which tie on short texts, where zstandard also stores
what it can not shorten as it is.  Where the first two languages are within
``tie_bytes``, or the margin is narrow, the measure is made finer, by
compression again: each dictionary is cut into ``fine_parts`` smaller ones, a
segment is repeated up to ``fine_bytes`` behind each of them, so that it is
never stored as it is, and the sizes are added up.  A word is then cheap in as
many parts as have it.  Where that margin is narrow too the text is rejected.
The rules are the same for texts of every length.

Training reads whole texts, at most ``sample_docs`` different ones of each
language and ``sample_chars`` characters together: those with the least hashes
of the text, texts longer than ``sample_chars`` last, but always one.  These
bounds are the only sampling.

Defined results: a text without a letter or null gives ``und`` with score 0 and
is rejected; ties go to the smaller language name and are rejected; a text of any length is read whole;
equal texts get equal results, repeated rows each theirs; with no training rows
every text is ``und``; an empty table gives no rows; input columns called
lang_pred, score or rejected are replaced, all others stay.  More than
``most_languages`` labels are an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import least_rows

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    sample_docs: int = 96
    sample_chars: int = 120_000
    segment_bytes: int = 4_096
    level: int = 5
    min_margin: float = 0.005  # of the second language's size
    tie_bytes: int = 3  # sizes this near are measured again, finer
    fine_parts: int = 32  # dictionaries that each is cut into for that, at most
    fine_least: int = 1_024  # bytes of such a part, at least
    fine_bytes: int = 128  # to which a shorter segment is repeated
    most_languages: int = 1_024


_OTHER = re.compile(r"[\W\d_]+")
_SPACES = re.compile(r" {2,}")


def letters(text: str) -> bytes:
    """Letters in lower case, everything between them one space."""
    out = _OTHER.sub(" ", text.lower())
    if not out.replace(" ", "").isalpha():  # signs such as a superscript two are word characters, but no letters
        out = _SPACES.sub(" ", "".join(c if c.isalpha() else " " for c in out))
    return out.encode()


def train(docs: DataFrame, train_if: Column, config: LangConfig = LangConfig()) -> list[tuple[str, bytes]]:
    """(language, dictionary) in order of name, from the rows where ``train_if`` holds and lang and text are not null."""
    rows = docs.filter(train_if & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"), F.char_length("text").alias("chars"))
    over = F.greatest(F.col("chars") - config.sample_chars, F.lit(0))
    ranked = least_rows(rows.select("lang", "h", "chars").distinct(), ["lang"], [over, F.col("h"), F.col("chars")], config.sample_docs, "n", F.xxhash64("h"))
    picked: dict[str, list[tuple[int, int]]] = {}
    room: dict[str, int] = {}
    for r in ranked.select("lang", "n", "h", "chars").orderBy("lang", "n").toLocalIterator():  # most_languages * sample_docs rows at most
        left = room.get(r["lang"], config.sample_chars)
        if len(room) > config.most_languages:
            raise ValueError("more languages than a model takes")
        if r["chars"] <= left or r["lang"] not in picked:
            picked.setdefault(r["lang"], []).append((r["h"], r["chars"]))
            room[r["lang"]] = left - r["chars"]
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame([(lang, h, c) for lang in picked for h, c in picked[lang]], "lang string, h long, chars int")
    texts = rows.join(F.broadcast(wanted), ["lang", "h", "chars"]).groupBy("lang", "h", "chars").agg(F.min("text").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in texts.toLocalIterator():  # sample_chars a language, or one longer text
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(lang, letters("\n".join(t for _, t in sorted(found[lang])))) for lang in sorted(found)]


def cut(data: bytes, parts: int) -> list[bytes]:
    """A dictionary in parts of about equal length, none empty."""
    step = max(1, -(-len(data) // parts))
    return [data[i : i + step] for i in range(0, len(data), step)]


def guesser(model: list[tuple[str, bytes]], config: LangConfig = LangConfig()) -> Callable[[str | None], tuple[str, float, bool]]:
    """A function from a text to (lang_pred, score, rejected)."""
    import zstandard

    def coder(data: bytes) -> zstandard.ZstdCompressor:
        table = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(level=config.level)
        return zstandard.ZstdCompressor(level=config.level, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)

    coders = [coder(data) for _, data in model]
    frame = 6  # bytes of frame and block headers, the same for all languages
    fine: list[list[zstandard.ZstdCompressor]] = []  # made when first needed

    def lead(sizes: list[float]) -> tuple[int, float, float]:
        """The least, its distance from the second, and that as a share of the second."""
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return best, second - sizes[best], (second - sizes[best]) / max(1, second)

    def guess(text: str | None) -> tuple[str, float, bool]:
        if text is None or not model or not (data := letters(text)).strip():
            return UNKNOWN, 0.0, True
        parts = [data[i : i + config.segment_bytes] for i in range(0, len(data), config.segment_bytes)]
        best, ahead, margin = lead([sum(max(1, len(c.compress(p)) - frame) for p in parts) for c in coders])
        if (margin < config.min_margin or ahead < config.tie_bytes) and len(model) > 1:
            if not fine:
                fine.extend([coder(p) for p in cut(d, max(1, min(config.fine_parts, len(d) // config.fine_least)))] for _, d in model)
            framed = [b" " + p.strip() + b" " for p in parts]
            framed = [p * -(-config.fine_bytes // len(p)) for p in framed]
            best, _, margin = lead([sum(max(1, len(c.compress(p)) - frame) for c in own for p in framed) / len(own) for own in fine])
        return model[best][0], min(1.0, margin), margin < config.min_margin

    return guess


def classify(docs: DataFrame, model: list[tuple[str, bytes]], config: LangConfig = LangConfig()) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, rejected."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        guess_one = guesser(model, config)
        for texts in batches:
            yield pd.DataFrame([guess_one(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    guess = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    names = docs.columns
    return docs.select(*[F.col(f"`{c}`") for c in names], guess(F.col("text")).alias("__guess")).select(*[F.col(f"`{c}`") for c in names if c not in ("lang_pred", "score", "rejected")], "__guess.lang_pred", "__guess.score", "__guess.rejected")
