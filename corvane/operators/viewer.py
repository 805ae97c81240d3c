"""What a reader of a cited document sees: passages by page, searchable pieces, highlight rectangles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: lengths of searchable pieces, and distances on a page in points
LEAST_PROSE = 24
LEAST_CELL = 4
MOST_SEARCH = 90
PADDING = 14.0
SAME_LINE = 2.0
TOUCH = 1.0
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
PASSAGE_FIELDS = ("chunk_id", "text", "page", "location", "chunk_type", "extraction_method")


def get(passages: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Passages by id; ids that are not there are passed over."""
    return passages.join(ids.select(key).distinct(), key, "left_semi")


def to_metadata(passages: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, text, metadata: every other field that is not null as a string in a map."""
    fields = [c for c in passages.columns if c not in (key, text, "embedding")]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in fields]), lambda x: x["value"].isNotNull())
    return passages.select(key, text, F.map_from_entries(entries).alias("metadata"))


def from_metadata(rows: DataFrame, fields: dict[str, str], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The fields (name to type) back as columns; an absent key is null."""
    return rows.select(key, text, *[F.element_at("metadata", c).cast(kind).alias(c) for c, kind in fields.items()])


def document_view(passages: DataFrame, source_doc: str, page: int | None = None) -> DataFrame:
    """A document's passages in order of page (none counts as 0), with the mark for those of the cited page that can be highlighted."""
    own = passages.filter(F.col("source_doc") == source_doc)
    lit = (F.col("extraction_method") == "text") & F.coalesce(F.col("page") == F.lit(page), F.lit(False)) if page is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("source_doc").orderBy(F.coalesce("page", F.lit(0)), "chunk_id"))
    return own.select(*PASSAGE_FIELDS, lit.alias("highlight"), place.alias("place"))


def is_rule(cell: Column) -> Column:
    """Whether a table cell is only the line under the head."""
    return cell.rlike(r"^[-: ]*$")


def segments(passages: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, at, part, cell: sentences of prose and table cells in order.

    A short line without a bar is searched whole, as a cell; a sentence ends
    at a full stop before white space or the line's end, and goes without it;
    shorter pieces are left out.
    """
    return passages.select(key, F.posexplode(parts(F.col("text"))).alias("at", "x")).select(key, "at", "x.part", "x.cell")


def parts(text: Column) -> Column:
    """The (part, cell) of a text in order, made inside its row."""

    def of_line(t: Column) -> Column:
        row = t.contains("|")
        short = (F.length(t) >= LEAST_CELL) & (F.length(t) < LEAST_PROSE) & ~row
        as_ = lambda cell: lambda x: F.struct(x.alias("part"), F.lit(cell).alias("cell"))
        cells = F.filter(F.transform(F.split(t, r"\|"), lambda x: F.trim(x)), lambda x: (F.length(x) >= LEAST_CELL) & ~is_rule(x))
        prose = F.filter(F.transform(F.split(t, r"\.(?=\s|$)"), lambda x: F.trim(x)), lambda x: F.length(x) >= LEAST_PROSE)
        return F.when(short, F.transform(F.array(t), as_(True))).when(row, F.transform(cells, as_(True))).otherwise(F.transform(prose, as_(False)))

    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n]")
    return F.flatten(F.transform(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), of_line))


def windows(sentence: str, most: int = MOST_SEARCH, least: int = LEAST_PROSE) -> list[str]:
    """A sentence in pieces of whole words; where the last would be short it reaches back from the end."""
    words = sentence.split()
    length = [0]
    for w in words:
        length.append(length[-1] + len(w) + 1)
    size = lambda i, j: length[j] - length[i] - 1
    out, start = [], 0
    while start < len(words):
        end = start + 1
        while end < len(words) and size(start, end + 1) <= most:
            end += 1
        out.append(" ".join(words[start:end]))
        if end < len(words) and size(end, len(words)) < least:
            start = len(words) - 1
            while start > 0 and size(start - 1, len(words)) <= most:
                start -= 1
            return [*out, " ".join(words[start:])]
        start = end
    return out


def pieces_of(part: str, cell: bool) -> list[str]:
    return [SPACE.sub(" ", part)] if cell or len(part) <= MOST_SEARCH else windows(part)


def search_pieces(passages: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, at, n, piece, cell: what is searched on a page; long sentences in windows."""

    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts:
            yield batch.map(windows)

    rows = segments(passages, key)
    pieces = F.when(F.col("cell") | (F.length("part") <= MOST_SEARCH), F.array(F.regexp_replace("part", r"\s+", " "))).otherwise(F.pandas_udf(cut, "array<string>")("part"))
    return rows.select(key, "at", "cell", F.posexplode(pieces).alias("n", "piece"))


def first_pieces(parts_: list[dict], most: int) -> list[tuple[int, str, bool]]:
    """The first (n, piece, cell) of a text's parts, those of ``search_pieces`` numbered through."""
    found = ((p, x["cell"]) for x in parts_ for p in pieces_of(x["part"], x["cell"]))
    return [(n, p, cell) for n, (p, cell) in enumerate(islice(found, most))]


def merge_rectangles(rects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0, y0, x1, y1: rectangles of one line that overlap or touch, as one.

    Lines are those of the rounded top; a rectangle opens an island where it
    begins beyond the right end of all before it on its line.
    """
    line = F.round("y0").alias("line")
    rows = rects.select(*keys, "x0", "y0", "x1", "y1", line)
    order = Window.partitionBy(*keys, "line").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("x0") <= reach + TOUCH, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "line", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("line", "island")


def within_anchors(hits: DataFrame, anchors: DataFrame, keys: list[str], padding: float = PADDING) -> DataFrame:
    """Hits between the anchors' top and bottom, a little beyond; where a group has no anchor all stay."""
    span = anchors.groupBy(*keys).agg((F.min("y0") - padding).alias("top"), (F.max("y1") + padding).alias("bottom"))
    rows = hits.join(span, keys, "left")
    return rows.filter(F.col("top").isNull() | ((F.col("y1") >= F.col("top")) & (F.col("y0") <= F.col("bottom")))).drop("top", "bottom")
