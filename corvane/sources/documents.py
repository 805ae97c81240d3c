"""Folders of DOCX, PDF and picture files as a Python data source, and one file as a table function: rows are the pieces of files.

A piece is a page of a PDF file, the text of a DOCX file, a picture, or an
error, which is the row of a file (or page) that cannot be read; other files of
its folder are not concerned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.sources import files, pdf

BOX = "x0:double,y0:double,x1:double,y1:double"
SCHEMA = (
    "filename string, type string, kind string, page int, number int, text string, width double, height double, "
    f"words array<struct<word:string,line:int,{BOX}>>, pictures array<struct<{BOX}>>, content binary, error string"
)
COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<.*?>+", "", SCHEMA).split(",")]
# fixed values: the leading bytes of the types
_LEADS = {"pdf": b"%PDF", "docx": b"PK\x03\x04", "jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n"}


def pieces(filename: str, content: bytes, part: int = 0, parts: int = 1) -> Iterator[dict]:
    """The pieces of a file; of a PDF file only the pages of this part, the first part has all others."""
    kind = next((k for k, lead in _LEADS.items() if content.startswith(lead)), None)
    own = {"filename": filename, "type": kind}
    try:
        if kind == "pdf":
            for page in pdf.read_pages(content, part, parts):
                yield own | page | {"kind": "error" if page["error"] else "page"}
        elif part:
            return
        elif kind is None:
            yield own | {"kind": "error", "error": "no reader for this kind of file"}
        elif kind == "docx":
            found = [own | {"kind": "text", "text": files.docx_text(content)}]
            for number, _, data in files.docx_images(content):
                found.append(own | {"kind": "picture", "number": number, "content": data} | _sized(data))
            yield from found  # whole or not at all
        else:
            yield own | {"kind": "picture", "number": 0, "content": content} | _sized(content)
    except Exception as e:  # noqa: BLE001 - a broken file raises whatever its reader meets
        yield own | {"kind": "error", "error": f"{type(e).__name__}: {e}"}


def _sized(content: bytes) -> dict:
    width, height = files.image_size(content) or (None, None)
    return {"width": None if width is None else float(width), "height": None if height is None else float(height)}


@F.udtf(returnType=SCHEMA)
class FilePieces:
    """(filename, content) of one file to its pieces, for a lateral join; null content has none."""

    def eval(self, filename: str, content: bytes) -> Iterator[tuple]:
        if content is not None:
            for piece in pieces(filename, bytes(content)):
                yield tuple(piece.get(c) for c in COLUMNS)


@dataclass
class Share(InputPartition):
    """What one task reads: (path, part, parts) of files."""

    files: list[tuple[str, int, int]]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.names = options["path"], schema.fieldNames()
        self.split = int(options.get("split_bytes", 32 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Conditions on the filename leave whole files unread."""
        for test in filters:
            if isinstance(test, (EqualTo, In, StringStartsWith)) and test.attribute == ("filename",):
                self.tests.append(test)
            else:
                yield test

    def wanted(self, name: str) -> bool:
        ask = {EqualTo: lambda t: name == t.value, In: lambda t: name in t.value, StringStartsWith: lambda t: name.startswith(t.value)}
        return all(ask[type(t)](t) for t in self.tests)

    def partitions(self) -> list[Share]:
        """Small files together up to the split size; a large one's pages are dealt to as many tasks as it has split sizes."""
        system, at = _open(self.path)
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        own = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and self.wanted(f.base_name))
        out: list[Share] = []
        room = 0
        for path, size in own:
            parts = max(1, -(-size // self.split))
            if parts > 1:
                out += [Share([(path, i, parts)]) for i in range(parts)]
                room = 0
                continue
            if room < size or not out:
                out.append(Share([]))
                room = self.split
            out[-1].files.append((path, 0, 1))
            room -= size
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path, part, parts in partition.files:
            with system.open_input_stream(path, compression=None) as stream:
                content = stream.read()
            for piece in pieces(path.rsplit("/", 1)[-1], content, part, parts):
                yield tuple(piece.get(c) for c in self.names)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format and the table function ``corvane_file_pieces`` known to the session."""
    spark.dataSource.register(DocumentSource)
    spark.udtf.register("corvane_file_pieces", FilePieces)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_documents(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("corvane_documents").options(**options).load(path)


#: Words of pieces that a task holds before it passes them on.
BATCH_WORDS = 100_000


def _batch(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Pieces as Arrow columns; lists of boxes as flat ones."""

    def column(field: pa.Field) -> pa.Array:
        own = [p.get(field.name) for p in held]
        if not pa.types.is_list(field.type):
            return pa.array(own, field.type)
        flat = list(zip(*(w for x in own for w in x or ()))) or [()] * field.type.value_type.num_fields
        ends = [0, *accumulate(len(x or ()) for x in own)]
        starts = pa.array([None if x is None else at for x, at in zip(own, ends)] + ends[-1:], pa.int32())  # of no list: null
        inner = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, field.type.value_type)], fields=list(field.type.value_type))
        return pa.ListArray.from_arrays(starts, inner, type=field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def file_pieces(rows: DataFrame) -> DataFrame:
    """The pieces of files that are rows (filename, content) already, as ``corvane_file_pieces`` has them, in Arrow batches; null content has none."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], BATCH_WORDS
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                for piece in pieces(name.as_py(), content.as_py()) if content.is_valid else ():
                    held.append(piece)
                    room -= 1 + len(piece.get("words") or ()) + len(piece.get("content") or ()) // 64
                    if room <= 0:
                        yield _batch(held, schema)
                        held, room = [], BATCH_WORDS
        if held:
            yield _batch(held, schema)

    return rows.select(F.col("filename").cast("string").alias("filename"), F.col("content").cast("binary").alias("content")).mapInArrow(read, SCHEMA)


# ---- what comes of the pieces


def outcomes(found: DataFrame) -> DataFrame:
    """filename, type, pages, pictures, error of every file; one failing page fails its file."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy("filename").agg(F.max("type").alias("type"), count("page").alias("pages"), count("picture").alias("pictures"), F.min(F.when(F.col("kind") == "error", F.col("error"))).alias("error"))


def pdf_pages(found: DataFrame) -> DataFrame:
    """source_doc, page, text, image_coverage of the pages, as ``extraction.route_pages`` takes them; pictures that overlap count twice, at most the whole page."""
    area = lambda b: F.abs((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    covered = F.aggregate("pictures", F.lit(0.0), lambda a, b: a + area(b))
    page = F.abs(F.col("width") * F.col("height"))
    return found.filter("kind = 'page'").select(F.col("filename").alias("source_doc"), "page", "text", F.when(page == 0, 0.0).otherwise(F.least(covered / page, F.lit(1.0))).alias("image_coverage"))


def word_rows(found: DataFrame) -> DataFrame:
    """source_doc, page, seq, word, line and box of every word of the PDF pages, for ``operators.locate``."""
    rows = found.filter("kind = 'page'")
    return rows.select(F.col("filename").alias("source_doc"), "page", F.posexplode("words").alias("seq", "w")).select("source_doc", "page", "seq", "w.*")


def text_layer(found: DataFrame, least: int = 200) -> DataFrame:
    """filename, pages, has_text: how many pages a PDF file has, and whether their text is more than ``least`` characters."""
    own = found.filter("kind = 'page'").groupBy("filename")
    return own.agg(F.count(F.lit(1)).alias("pages"), (F.sum(F.length(F.trim("text"))) > least).alias("has_text"))
