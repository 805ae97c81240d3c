"""Files: the PDF text layer, the data source over a folder, and a folder through the engine to marked pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import locate
from corvane.plans.engine import Engine
from corvane.sources import documents, files, pdf

PNG = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (80).to_bytes(4, "big") + (70).to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
LINES = st.lists(st.lists(st.lists(st.text(st.characters(exclude_categories=("Z", "C")), min_size=1, max_size=6), min_size=1, max_size=4).map(" ".join), max_size=4), max_size=3)


@settings(max_examples=60, deadline=None)
@given(LINES, st.booleans())
def test_round_trip(pages, streams):
    pages = [[x for x in p if not any(c.isspace() for w in x.split(" ") for c in w)] for p in pages]
    back = list(pdf.read_pages(pdf.build_pdf(pages, streams=streams)))
    assert [p["text"] for p in back] == ["\n".join(p) for p in pages] and not any(p["error"] for p in back)


def raw(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/X>>", more=b""):
    """A file without cross-references: it can only be scanned."""
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]/MediaBox[0 0 100 200]>>endobj 3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F %s>>/XObject<</P 5 0 R>>>>>>endobj\n4 0 obj<</Length %d>>stream\n%s\nendstream endobj %s" % (font, len(content), content, more)


def test_drawing():
    text = lambda *a: next(iter(pdf.read_pages(raw(*a))))["text"]
    assert text(rb"BT /F 10 Tf 10 100 Td (a\(b\)\\ \101\n(c)) Tj ET") == "a(b)\\ A (c)"
    assert text(b"BT /F 10 Tf 12 TL 10 100 Td [(wo) -20 (rd) -800 (next)] TJ (line) ' <6C> Tj ET") == "word next\nlinel"
    assert text(b"BT /F 10 Tf 1 0 0 1 10 100 Tm (caf\xe9) Tj 1 0 0 1 10 80 Tm (\x80) Tj ET % (no) Tj") == "café\n€"
    assert text(b"BT /F 10 Tf (A#) Tj ET", b"<</Subtype/Type1/Encoding<</Differences[35/uni20AC/B]>>>>") == "A€"
    form = b"5 0 obj<</Subtype/Form/Matrix[1 0 0 1 5 5]/Length 28>>stream\nBT /F 10 Tf (inside) Tj ET    \nendstream endobj"
    assert text(b"q 2 0 0 2 0 0 cm /P Do Q BI /W 1 ID (x) Tj EI BT /F 9 Tf (after) Tj ET", b"<</Subtype/Type1>>", form) == "inside\nafter"
    image = b"5 0 obj<</Subtype/Image/Length 0>>stream\n\nendstream endobj"
    assert next(iter(pdf.read_pages(raw(b"q 50 0 0 100 10 20 cm /P Do Q", b"null", image))))["pictures"] == [(10.0, 80.0, 60.0, 180.0)]
    bad = next(iter(pdf.read_pages(raw(b"BT (never ends"))))
    assert bad["error"] == "PdfError: a string does not end" and bad["text"] is None
    word = next(iter(pdf.read_pages(raw(b"BT /F 10 Tf 10 100 Td (ab) Tj ET"))))["words"]
    assert word == [("ab", 0, 10.0, 92.0, 20.0, 102.0)]


def test_parts_of_the_format():
    assert pdf.value(b" [1 -2.5 .5 /A#20b (x(y)z) <4a4> true null 3 0 R] ", 0)[0] == [1, -2.5, 0.5, "A b", b"x(y)z", b"J@", True, None, pdf.Ref(3, 0)]
    assert pdf.to_unicode(b"2 beginbfrange <0001> <0003> <0041> <10> <11> [<0062> <00660069>] endbfrange 1 beginbfchar <20> <D83DDE00> endbfchar") == {1: "A", 2: "B", 3: "C", 16: "b", 17: "fi", 32: "😀"}
    assert pdf.unpredicted(bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1]), 3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])
    for broken in (b"%PDF-1.7 nothing", b"no pdf", pdf.build_pdf([["x"]]).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")):
        with pytest.raises(pdf.PdfError):
            list(pdf.read_pages(broken))
    whole = pdf.build_pdf([["one"], ["two"], ["three"]], streams=True)
    assert [p["text"] for i in range(2) for p in pdf.read_pages(whole, i, 2)] == ["one", "three", "two"]
    assert [p["text"] for p in pdf.read_pages(whole.replace(b"startxref", b"startxxxx"))] == ["one", "two", "three"]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "files"
    (at / "inner").mkdir(parents=True)
    prose = ["The quarterly revenue of the northern branch grew by 26.0 percent", "against the year before, which nobody had expected at all."]
    (at / "a.pdf").write_bytes(pdf.build_pdf([["Heading here", *prose], ["x"], prose[:1]], {2}, True))
    (at / "inner" / "b.docx").write_bytes(files.build_docx([("Rules", "Dogs are allowed in the garden.")]))
    (at / "c.png").write_bytes(PNG)
    (at / "broken.pdf").write_bytes(b"%PDF-1.4 nothing to see")
    (at / "broken.docx").write_bytes(b"PK\x03\x04broken")
    (at / "empty.pdf").write_bytes(pdf.build_pdf([[]]))
    (at / "notes.txt").write_bytes(b"plain")
    (at / ".hidden").write_bytes(b"plain")
    return str(at)


def test_data_source(spark, folder):
    rows = documents.read_documents(spark, folder)
    got = {(r.filename, r.kind, r.page): r for r in rows.collect()}
    assert set(got) == {("a.pdf", "page", 1), ("a.pdf", "page", 2), ("a.pdf", "page", 3), ("b.docx", "text", None), ("c.png", "picture", None), ("broken.pdf", "error", None), ("broken.docx", "error", None), ("empty.pdf", "page", 1), ("notes.txt", "error", None)}
    assert got["b.docx", "text", None].text == "## Rules\n\nDogs are allowed in the garden." and (got["c.png", "picture", None].width, got["c.png", "picture", None].content) == (80.0, PNG)
    assert got["broken.docx", "error", None].error.startswith("BadZipFile") and got["notes.txt", "error", None].error.startswith("no reader")
    whole = sorted((r.filename, r.kind, str(r.page), r.text) for r in got.values())
    small = documents.read_documents(spark, folder, split_bytes=300)  # large files are dealt by pages
    assert small.rdd.getNumPartitions() > rows.rdd.getNumPartitions() and sorted((r.filename, r.kind, str(r.page), r.text) for r in small.collect() if r.kind != "error") == [w for w in whole if w[1] != "error"]
    assert {r.filename for r in small.filter("kind = 'error'").collect()} == {"broken.pdf", "broken.docx", "notes.txt"}
    one = rows.filter("filename = 'a.pdf'")
    assert one.count() == 3 and "filename" in one._jdf.queryExecution().executedPlan().toString() and rows.filter("filename IN ('c.png', 'none')").count() == 1 and rows.filter("filename LIKE 'broken%'").count() == 2
    assert {r.filename: (r.pages, r.has_text) for r in documents.text_layer(rows, 150).collect()} == {"a.pdf": (3, True), "empty.pdf": (1, False)}
    named = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").filter("filename <> '.hidden'")
    named = named.unionByName(spark.createDataFrame([("null", None)], "filename string, content binary"))
    assert sorted((r.filename, r.kind, str(r.page), r.text) for r in documents.file_pieces(named).collect()) == whole
    (spark.createDataFrame([("f", pdf.build_pdf([["via SQL"]]))], "filename string, content binary")).createOrReplaceTempView("held_files")
    assert spark.sql("SELECT p.text FROM held_files, LATERAL corvane_file_pieces(filename, content) p").collect()[0].text == "via SQL"


def test_folder_through_the_engine(spark, folder):
    plan = spark.createDataFrame([("a.pdf", 3)], "source_doc string, page int")
    seen = spark.createDataFrame([("a.pdf", 2, None, "a bar chart\n\nof many words", "chart", "ocr"), ("a.pdf", 3, None, " ", "table", "vision"), ("broken.pdf", 1, None, "lost", "text", "ocr")], "source_doc string, page int, location string, text string, chunk_type string, extraction_method string")
    old = Engine(spark).ingest(spark.createDataFrame([("broken.pdf", "an earlier version"), ("empty.pdf", "was here")], "source_doc string, text string"))
    engine, outcomes, units = old.ingest_folder(folder, plan, seen)
    told = {r.filename: (r.pages, r.pictures, r.error is None) for r in outcomes.collect()}
    assert told == {"a.pdf": (3, 0, True), "b.docx": (0, 0, True), "c.png": (0, 1, True), "broken.pdf": (0, 0, False), "broken.docx": (0, 0, False), "empty.pdf": (1, 0, True), "notes.txt": (0, 0, False)}
    assert {(r.source_doc, r.page, r.number, r.reader) for r in units.collect()} == {("a.pdf", 2, None, "ocr"), ("a.pdf", 3, None, "vision"), ("c.png", None, 0, "vision")}
    got = {(r.source_doc, r.page, r.chunk_type, r.extraction_method): r.text for r in engine.passages.collect()}
    assert set(got) == {("a.pdf", 1, "text", "text"), ("a.pdf", 3, "text", "text"), ("a.pdf", 2, "chart", "ocr"), ("b.docx", None, "text", "text"), ("broken.pdf", None, "text", "text")}  # the failed file keeps its passages, the empty one has none left
    assert got["a.pdf", 2, "chart", "ocr"] == "a bar chart\n\nof many words" and got["broken.pdf", None, "text", "text"] == "an earlier version"
    again, _, _ = engine.ingest_folder(folder, plan, seen)
    assert sorted(r.chunk_id for r in again.passages.collect()) == sorted(r.chunk_id for r in engine.passages.collect())
    words = documents.word_rows(documents.read_documents(spark, folder))
    marks = locate.highlights(engine.passages.filter("page = 1"), words).collect()
    assert sorted(r.y0 for r in marks) == [34.0, 46.0, 58.0] and min(r.x0 for r in marks) == 40.0


def test_level_strings_are_drawn_as_runs(monkeypatch):
    fonts = [b"<</Subtype/Type1>>", b"<</Subtype/Type1/FirstChar 97/Widths[250 300 -400]>>", b"<</Subtype/Type1/Encoding<</Differences[32/A 98/space]>>>>"]
    shown = [b"BT /F 10 Tf %s 10 100 Td (ab  ba ) Tj [(b b) -300 (a)] TJ T* (a a) ' ET" % x for x in (b"", b"1 Tc", b"9 Tc", b"-2 Tc", b"3 Tw", b"80 Tz 2 Ts", b"-90 Tz", b"0 1 -1 0 50 50 Tm", b"1 .2 0 1 5 5 Tm")]
    read = lambda: [next(iter(pdf.read_pages(raw(x, f)))) for x in shown for f in fonts]
    seen = []
    whole = pdf.words
    monkeypatch.setattr(pdf, "words", lambda glyphs, *a: (seen.append(len(glyphs)), whole(glyphs, *a))[1])
    runs = read()
    assert seen[0] == 11  # of 14 glyphs
    monkeypatch.setattr(pdf.Drawing, "_show_level", lambda *a: None)
    for a, b in zip(runs, read(), strict=True):
        assert a["text"] == b["text"] and len(a["words"]) == len(b["words"])
        for v, w in zip(a["words"], b["words"]):
            assert v[:2] == w[:2] and v[2:] == pytest.approx(w[2:])


def test_pieces_in_small_batches(spark, monkeypatch):
    held = [("a", pdf.build_pdf([["x y"], [], ["z"]])), ("b", None), ("c", PNG), ("d", b"?"), (None, pdf.build_pdf([["q"]]))]
    rows = spark.createDataFrame(held, "filename string, content binary")
    found = sorted((str(r.filename), r.kind, r.page or 0, r.text or "", None if r.words is None else [w.word for w in r.words], r.content and bytes(r.content)) for r in documents.file_pieces(rows).collect())
    assert [x[:5] for x in found] == [("None", "page", 1, "q", ["q"]), ("a", "page", 1, "x y", ["x", "y"]), ("a", "page", 2, "", []), ("a", "page", 3, "z", ["z"]), ("c", "picture", 0, "", None), ("d", "error", 0, "", None)]
    assert found[4][5] == PNG
    assert "MapInArrow" in documents.file_pieces(rows)._jdf.queryExecution().toString()
