"""Files as rows: type detection, DOCX text and tables, questions, manifests, JSON lines."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_type(content: Column) -> Column:
    """By the leading bytes alone: pdf, docx, jpeg, png, or null for anything else."""
    lead = F.hex(F.substring(content, 1, 8))
    return F.when(lead.startswith("25504446"), "pdf").when(lead.startswith("504B0304"), "docx").when(lead.startswith("FFD8FF"), "jpeg").when(lead == "89504E470D0A1A0A", "png")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, type of every file under the path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", file_type(F.col("content")).alias("type"))


# ---- DOCX: paragraphs, a grid for every table, style names

#: fixed values: what the elements of a run stand for, beside their text
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def run_text(node: ElementTree.Element) -> str:
    """The text of a paragraph or cell, tabs and line breaks included; a cell's paragraphs are lines."""
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}p" and out:
            out.append("\n")
        else:
            out.append(_MARKS.get(x.tag, ""))
    return "".join(out)


def _value(node: ElementTree.Element, path: str, default: str) -> str | None:
    """The ``val`` of the element at the path: the default where it has none, None where there is no such element."""
    found = node.find("/".join(_W + x for x in path.split("/")))
    return None if found is None else found.get(f"{_W}val", default)


def table_grid(table: ElementTree.Element) -> dict[tuple[int, int], str]:
    """(row, column) to text for every cell that begins there: cells merged down or across have theirs once."""
    grid = {}
    for r, row in enumerate(table.findall(f"{_W}tr")):
        column = int(_value(row, "trPr/gridBefore", "0") or 0)
        for cell in row.findall(f"{_W}tc"):
            if _value(cell, "tcPr/vMerge", "continue") != "continue":
                grid[r, column] = " ".join(run_text(cell).split()).replace("|", "\\|")
            else:
                grid[r, column] = ""
            column += int(_value(cell, "tcPr/gridSpan", "1") or 1)
        grid[r, column - 1] = grid.get((r, column - 1), "")
    return grid


def grid_markdown(grid: dict[tuple[int, int], str]) -> str:
    """A markdown table of the grid's rows that have text, the first of them its head."""
    used = sorted({r for (r, _), text in grid.items() if text})
    if not used:
        return ""
    columns = range(1 + max(c for r, c in grid if r in set(used)))
    line = lambda cells: f"| {' | '.join(cells)} |"
    head, *body = [line([grid.get((r, c), "") for c in columns]) for r in used]
    return "\n".join([head, line(["---"] * len(columns)), *body])


def heading_styles(archive: zipfile.ZipFile) -> set[str]:
    """Ids of the paragraph styles called Title or Heading ...; ids differ between languages of the program, names do not."""
    try:
        styles = ElementTree.fromstring(archive.read("word/styles.xml"))
    except KeyError:
        styles = ElementTree.Element("none")
    named = {x.get(f"{_W}styleId", ""): (_value(x, "name", "") or "").lower() for x in styles.iter(f"{_W}style")}
    return {i for i, name in named.items() if is_heading(name)}


def is_heading(style: str) -> bool:
    return style.lower() == "title" or style.lower().startswith("heading")


def docx_text(content: bytes) -> str:
    """The body in document order: headings as ## lines, tables as markdown, blocks joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        headings = heading_styles(archive)
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    parts = {f"{_W}tbl": lambda x: grid_markdown(table_grid(x)), f"{_W}p": lambda x: _paragraph(x, headings)}
    return "\n\n".join(filter(None, (parts[x.tag](x) for body in root.iter(f"{_W}body") for x in body if x.tag in parts)))


def _paragraph(node: ElementTree.Element, headings: set[str]) -> str:
    text, style = run_text(node).strip(), _value(node, "pPr/pStyle", "") or ""
    return f"## {text}" if text and (style in headings or is_heading(style)) else text


def docx_images(content: bytes) -> list[tuple[int, str, bytes]]:
    """(number, name, bytes) of the pictures in the order of their first use in the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        links = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else ()
        target = {x.get("Id"): "word/" + (x.get("Target") or "").removeprefix("/word/") for x in links}
        uses = [v for x in ElementTree.fromstring(archive.read("word/document.xml")).iter() for k, v in x.attrib.items() if k.endswith("}embed")]
        found = [target[u] for u in dict.fromkeys(uses) if target.get(u) in names]
        return [(i, name, archive.read(name)) for i, name in enumerate(found)]


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG from its header."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content):
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def build_docx(sections: list[tuple[str | None, str]]) -> bytes:
    """A small DOCX file of (heading, text) sections, for trials."""
    space = _W.strip("{}")
    word = lambda text, style="": f"<w:p>{style}<w:r><w:t xml:space='preserve'>{escape(text)}</w:t></w:r></w:p>"
    heading = "<w:pPr><w:pStyle w:val='Heading1'/></w:pPr>"
    body = "".join((word(h, heading) if h else "") + "".join(word(line) for line in text.split("\n")) for h, text in sections)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document xmlns:w='{space}'><w:body>{body}</w:body></w:document>")
        archive.writestr("word/styles.xml", f"<w:styles xmlns:w='{space}'><w:style w:styleId='Heading1'><w:name w:val='heading 1'/></w:style></w:styles>")
    return out.getvalue()


def extract_docx(files: DataFrame) -> DataFrame:
    """filename, text, error of every DOCX file; a broken file has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, content in zip(rows["filename"], rows["content"], strict=True):
                try:
                    out.append((name, docx_text(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((name, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["filename", "text", "error"])

    return files.filter(file_type(F.col("content")) == "docx").select("filename", "content").mapInPandas(run, "filename string, text string, error string")


def plan_images(images: DataFrame, least_bytes: int = 4_096, least_side: int = 64) -> DataFrame:
    """Embedded images (source_doc, number, content, width, height) with kept or the reason for skipping; repeats by content go."""
    first = Window.partitionBy("source_doc", F.sha2("content", 256)).orderBy("number")
    rows = images.withColumn("n", F.row_number().over(first))
    why = F.when(F.col("n") > 1, "repeated").when(F.length("content") < least_bytes, "few bytes").when(F.least("width", "height") < least_side, "too small")
    return rows.select("source_doc", "number", why.alias("skipped"))


_QUESTION = "id string, category string, question string, ground_truth string, reference_answer string, requires_tables_charts boolean, visual_dependent boolean, reference_sources array<struct<source_doc:string,doc:string,pages:array<int>,page:int>>, sources array<struct<source_doc:string,doc:string,pages:array<int>,page:int>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON list or {"questions": [...]}; older key names are understood."""
    text = spark.read.text(path, wholetext=True).select("value")
    rows = text.select(F.coalesce(F.from_json(F.get_json_object("value", "$.questions"), f"array<struct<{_struct(_QUESTION)}>>"), F.from_json("value", f"array<struct<{_struct(_QUESTION)}>>")).alias("q"))
    rows = rows.select(F.posexplode("q").alias("at", "q")).select("at", "q.*")
    sources = F.transform(F.coalesce("reference_sources", "sources", F.array().cast("array<struct<source_doc:string,doc:string,pages:array<int>,page:int>>")), lambda s: F.struct(F.coalesce(s["source_doc"], s["doc"]).alias("source_doc"), F.coalesce(s["pages"], F.when(s["page"].isNotNull(), F.array(s["page"])), F.array().cast("array<int>")).alias("pages")))
    return rows.select(F.coalesce("id", F.format_string("Q%02d", F.col("at") + 1)).alias("id"), "category", "question", F.coalesce("ground_truth", "reference_answer").alias("ground_truth"), F.coalesce("requires_tables_charts", "visual_dependent", F.lit(False)).alias("requires_tables_charts"), sources.alias("reference_sources"))


def _struct(ddl: str) -> str:
    """Column list to struct fields."""
    depth, out = 0, []
    for c in ddl:
        depth += (c == "<") - (c == ">")
        out.append(c)
    fields, field, depth = [], "", 0
    for c in "".join(out):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            fields.append(field.strip())
            field = ""
        else:
            field += c
    fields.append(field.strip())
    return ",".join(f.replace(" ", ":", 1) for f in fields)


MANIFEST = "filename string, doc_type string, title string, source_url string, has_tables_charts string, pages int, license_note string"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV with a header and a fixed schema; a missing column is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; the tolerant reader drops malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest_violations(manifest: DataFrame, types: tuple[str, ...] = ("pdf", "docx", "image")) -> DataFrame:
    """filename, rule for every rule that a row breaks."""
    again = F.count(F.lit(1)).over(Window.partitionBy("filename")) > 1
    rules = {
        "empty filename": F.coalesce(F.trim("filename") == "", F.lit(True)),
        "duplicate filename": again,
        "unsafe filename": F.col("filename").rlike(r"[/\\]|^\.\."),
        "unknown type": ~F.coalesce(F.col("doc_type").isin(*types), F.lit(False)),
        "bad flag": ~F.coalesce(F.lower("has_tables_charts").isin("yes", "no"), F.lit(False)),
        "bad pages": F.coalesce(F.col("pages") < 1, F.lit(True)),
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())
    return manifest.withColumn("rules", found).select("filename", F.explode("rules").alias("rule"))


def route(files: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """filename, type, text, error of all files: each type goes to its extractor (filename, content to filename, text, error); others have an error."""
    typed = files.withColumn("type", file_type(F.col("content")))
    known = F.coalesce(F.col("type").isin(*extractors), F.lit(False))
    out = typed.filter(~known).select("filename", "type", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no extractor for "), F.coalesce("type", F.lit("this kind of file"))).alias("error"))
    for kind, extract in extractors.items():
        own = extract(typed.filter(F.col("type") == kind).select("filename", "content"))
        out = out.unionByName(own.select("filename", F.lit(kind).alias("type"), "text", "error"))
    return out


def provider_extractor(read: Callable[[bytes], str]) -> Callable[[DataFrame], DataFrame]:
    """An extractor of a function from bytes to text (a PDF reader, OCR, a vision model); one file's failure is its own."""

    def extract(files: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = []
                for name, content in zip(rows["filename"], rows["content"], strict=True):
                    try:
                        out.append((name, read(bytes(content)), None))
                    except Exception as e:  # noqa: BLE001 - whatever a reader raises concerns this file alone
                        out.append((name, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["filename", "text", "error"])

        return files.mapInPandas(run, "filename string, text string, error string")

    return extract


def docx_picture_rows(files: DataFrame) -> DataFrame:
    """source_doc, number, content, width, height: the pictures of DOCX files in the order of their use; of other formats the size is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["filename"], rows["content"], strict=True):
                found = [(name, i, data, *(image_size(data) or (None, None))) for i, _, data in docx_images(bytes(content))]
                yield pd.DataFrame(found, columns=["source_doc", "number", "content", "width", "height"])

    own = files.filter(file_type(F.col("content")) == "docx").select("filename", "content")
    return own.mapInPandas(run, "source_doc string, number int, content binary, width int, height int")


def has_pictures(content: bytes) -> bool:
    """Whether a DOCX has any embedded picture."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return any(x.startswith("word/media/") for x in archive.namelist())


# ---- originals, by name


def safe_name(filename: Column) -> Column:
    """Whether a name stays in its folder."""
    return ~filename.rlike(r"[/\\\x00]") & ~filename.isin("", ".", "..")


def find_originals(wanted: DataFrame, folders: list[DataFrame]) -> DataFrame:
    """filename, content of the wanted names, from the first folder that has each; unsafe names are not looked for."""
    both = None
    for i, folder in enumerate(folders):
        own = folder.select("filename", "content", F.lit(i).alias("folder"))
        both = own if both is None else both.unionByName(own)
    asked = wanted.filter(safe_name(F.col("filename"))).select("filename").distinct()
    first = Window.partitionBy("filename").orderBy("folder")
    return both.join(asked, "filename", "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1").select("filename", "content")


def delete_originals(stored: DataFrame, names: DataFrame) -> DataFrame:
    return stored.join(names.select("filename"), "filename", "left_anti")


# ---- checkpoints


def write_json_atomic(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """JSON lines that appear whole or not at all: written beside, then put in the place of what was there.

    What was there is renamed aside first and deleted last, so it is never lost:
    the next write, or ``recover_json``, puts it back where a writer died between.
    """
    beside, aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old"
    rows.write.json(beside)
    recover_json(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, at, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, aside))
    system = at.getFileSystem(conf)
    if system.exists(at) and not system.rename(at, old):
        raise OSError(f"could not rename {path}")
    if not system.rename(new, at):
        system.rename(old, at)
        raise OSError(f"could not rename to {path}")
    system.delete(old, True)


def recover_json(spark: SparkSession, path: str) -> None:
    """Puts back what a writer that died had renamed aside, or deletes it where the new version is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    system = at.getFileSystem(conf)
    if system.exists(old):
        if system.exists(at):
            system.delete(old, True)
        elif not system.rename(old, at):
            raise OSError(f"could not put {path} back")


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows at the end of a folder of CSV files, each with its header, which a reader takes once."""
    rows.write.mode("append").option("header", True).csv(path)
