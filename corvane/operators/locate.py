"""Where the pieces of a passage stand on its page: positional search over word boxes, and what is marked of it.

Words have the keys of their page, seq (reading order), word, line, x0, y0,
x1, y1; or they come as pages, a row with these in arrays in reading order.  A
passage meets its page by an equal join, and its pieces are found there by
position, so neither pieces nor words are rows of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.operators import viewer

MOST_SEARCHES = 60  # fixed value: pieces of a passage that are searched
PAGE = ["source_doc", "page"]


def flat(text: str) -> str:
    """Lower case, white space as single blanks."""
    return viewer.SPACE.sub(" ", text.lower()).strip(" ")


WORD = ("word", "line", "x0", "y0", "x1", "y1")


def paged(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Words as pages: keys, and arrays in reading order.  A page is one row: its size is that of a printed page."""
    own = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *WORD))).alias("own"))
    return own.select(*keys, *[F.col("own")[c].alias(c) for c in WORD])


class _Page:
    """A page's text, a blank between words, and where its words stand; a hyphen at a line's end joins its word with the next.  Blank words go."""

    def __init__(self, words: list[tuple]) -> None:
        rows = [(w, *rest) for word, *rest in words if (w := flat(word or ""))]
        glued, self.starts, self.stops, self.boxes, at = [], [], [], [], 0
        for i, (w, line, *box) in enumerate(rows):
            after = rows[i + 1][1] if i + 1 < len(rows) else None
            broken = len(w) > 1 and w.endswith("-") and after is not None and line is not None and after != line
            w = w[:-1] if broken else w
            glued.append(w if after is None or broken else w + " ")
            self.starts.append(at)
            self.stops.append(at + len(w))
            self.boxes.append((line, *box))
            at += len(glued[-1])
        self.text = "".join(glued)

    def rectangles(self, begin: int, end: int) -> list[list]:
        """[line, x0, y0, x1, y1] of a stretch of the text, one for each line; a word takes part by the share of its characters."""
        lines: dict[Any, list] = {}
        for i in range(bisect_right(self.stops, begin), bisect_left(self.starts, end)):
            line, x0, y0, x1, y1 = self.boxes[i]
            start, stop = self.starts[i], self.stops[i]
            share = lambda at: None if x0 is None or x1 is None else x0 + (x1 - x0) * (at - start) / (stop - start)  # noqa: B023, E731
            box = [share(max(start, begin)), y0, share(min(stop, end)), y1]
            old = lines.get(line)
            if old is None:
                lines[line] = [line, *box]
            else:
                for j, (f, v) in enumerate(zip((min, min, max, max), box), 1):
                    old[j] = v if old[j] is None else old[j] if v is None else f(old[j], v)
        return list(lines.values())

    def hits(self, piece: str) -> Iterator[tuple]:
        """(hit, line, x0, y0, x1, y1), from the left and without overlaps."""
        at, hit = self.text.find(piece), 0
        while at >= 0:
            for rectangle in self.rectangles(at, at + len(piece)):
                yield hit, *rectangle
            at, hit = self.text.find(piece, at + len(piece)), hit + 1


def _list(values: pa.Array) -> list:
    return values.to_numpy().tolist() if pa.types.is_primitive(values.type) and not values.null_count else values.to_pylist()


def _searched(schema: pa.Schema, cut: bool):
    """Rows of key, pieces (or parts, to be cut into pieces) and a page's arrays to rectangles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for first in range(0, large.num_rows, 1_000):
                batch = large.slice(first, 1_000)
                rows: list[tuple] = []
                arrays = [batch.column(i) for i in range(2, batch.num_columns)]
                for i in range(batch.num_rows):
                    page, own = _Page(list(zip(*(_list(a[i].values) for a in arrays)))), batch.column(1)[i].as_py()
                    for n, piece, cell in viewer.first_pieces(own, MOST_SEARCHES) if cut else ((p["n"], p["piece"], p["cell"]) for p in own):
                        piece = flat(piece or "")
                        if piece:
                            rows += [(i, n, cell, *hit) for hit in page.hits(piece)]
                if rows:
                    at, *columns = zip(*rows)
                    made = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(schema.field(0).type), *made], schema=schema)

    return run


def hits(pieces: DataFrame, words: DataFrame, key: str = "chunk_id", keys: list[str] = PAGE) -> DataFrame:
    """key, n, cell, hit, line, x0, y0, x1, y1: a rectangle for each line of each occurrence of a piece on its page.

    Pieces have the page's keys, key, n, piece and cell.  An occurrence may
    begin or end within a word, of which it takes the share of its characters.
    Pieces without text are not searched; those that are not there have no row.
    """
    asked = pieces.select(*keys, key, "n", F.col("piece"), "cell")
    return _hits(asked.groupBy(*keys, key).agg(F.collect_list(F.struct("n", "piece", "cell")).alias("pieces")), words, key, keys)


def _hits(asked: DataFrame, words: DataFrame, key: str, keys: list[str], cut: bool = False) -> DataFrame:
    """``hits`` of passages (the page's keys, key, pieces); with ``cut`` of the first pieces of their parts."""
    pages = words if "seq" not in words.columns else paged(words, keys)
    boxes = [F.col(c).cast("array<double>").alias(c) for c in WORD[2:]]
    rows = asked.join(pages, keys).select(key, "pieces", "word", "line", *boxes)
    kinds = {f.name: f.dataType for f in rows.schema}
    number = "integer" if cut else kinds["pieces"].elementType["n"].dataType
    out = StructType().add(key, kinds[key]).add("n", number).add("cell", "boolean").add("hit", "integer").add("line", kinds["line"].elementType)
    for c in WORD[2:]:
        out = out.add(c, "double")
    return rows.mapInArrow(_searched(to_arrow_schema(out), cut), out)


def with_single(rects: DataFrame, key: str = "chunk_id") -> DataFrame:
    """With ``single``: whether a piece's rectangles are one occurrence, each line right below the one before and reaching back under it."""
    order = Window.partitionBy(key, "n").orderBy("y0", "x0")
    gap = F.col("y0") - F.lag("y1").over(order)
    follows = F.coalesce((gap >= 0) & (gap < viewer.PADDING / 2) & (F.col("x0") < F.lag("x1").over(order)), F.lit(True))
    return rects.withColumn("follows", follows).withColumn("single", F.min("follows").over(Window.partitionBy(key, "n"))).drop("follows")


def highlights(passages: DataFrame, words: DataFrame, key: str = "chunk_id", keys: list[str] = PAGE) -> DataFrame:
    """key, x0, y0, x1, y1: what is marked of each passage (key, the page's keys, text, extraction_method) on its page.

    Only passages of a text layer are searched, by their first pieces.  Prose
    that is there once is an anchor; with anchors, what lies outside their
    height, a line beyond it included, is another place's and goes.
    """
    own = passages.filter("extraction_method = 'text'").repartition(*keys)  # before they are cut: a table's files may be few
    own = own.select(key, *keys, viewer.parts(F.col("text")).alias("pieces"))
    found = with_single(_hits(own, words, key, keys, cut=True).repartition(key), key)  # what follows is by passage, and dealt once
    # as viewer.within_anchors, without reading what was found twice
    own, anchor = Window.partitionBy(key), lambda c: F.when(F.col("single") & ~F.col("cell"), F.col(c))
    rows = found.withColumn("top", F.min(anchor("y0")).over(own) - viewer.PADDING).withColumn("bottom", F.max(anchor("y1")).over(own) + viewer.PADDING)
    near = rows.filter(F.col("top").isNull() | ((F.col("y1") >= F.col("top")) & (F.col("y0") <= F.col("bottom"))))
    return viewer.merge_rectangles(near, [key])
