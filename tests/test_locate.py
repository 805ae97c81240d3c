"""Pieces of passages on their pages: small layouts by hand, and whole documents against a plain loop."""

import re

from corvane import report_queries  # noqa: F401 - registers its queries
from corvane import queries
from corvane.operators import locate, viewer

WORDS = "source_doc string, page int, seq int, word string, line int, x0 double, y0 double, x1 double, y1 double"


def lay(doc, page, lines, gap=14.0):
    out = []
    for n, line in enumerate(lines):
        x = 0.0
        for w in line.split(" "):
            out.append((doc, page, len(out), w, n, x, n * gap, x + 10.0 * len(w), n * gap + 10))
            x += 10.0 * (len(w) + 1)
    return out


def found(spark, words, pieces):
    rows = [("a", 1, "k", i, p, False) for i, p in enumerate(pieces)]
    asked = spark.createDataFrame(rows, "source_doc string, page int, chunk_id string, n int, piece string, cell boolean")
    rects = locate.with_single(locate.hits(asked, spark.createDataFrame(words, WORDS)))
    return sorted((r.n, r.hit, r.line, r.x0, r.x1, r.single) for r in rects.collect())


def test_hits(spark):
    words = lay("a", 1, ["The Revenue grew by", "26.0 in a won-", "derful year, 126.05", "then 26.0"])
    words += [("a", 1, 99, " ", 9, 0.0, 0.0, 0.0, 0.0), ("a", 1, 98, None, 9, 0.0, 0.0, 0.0, 0.0)]
    got = found(spark, words, ["revenue  grew by 26.0", "wonderful year", "26.0", "absent", "", r"a\E(b"])
    assert [g for g in got if g[0] == 0] == [(0, 0, 0, 40.0, 190.0, True), (0, 0, 1, 0.0, 40.0, True)]
    assert [g for g in got if g[0] == 1] == [(1, 0, 1, 100.0, 140.0, True), (1, 0, 2, 0.0, 110.0, True)]  # broken at the line's end
    assert [(g[1], g[2], g[3], g[4]) for g in got if g[0] == 2] == [(0, 1, 0.0, 40.0), (1, 2, 140.0, 180.0), (2, 3, 50.0, 90.0)]  # also within 126.05
    assert not any(g[5] for g in got if g[0] == 2) and {g[0] for g in got} == {0, 1, 2}
    assert found(spark, lay("a", 1, [r"x a\E(b"]), [r"a\E(b"]) == [(0, 0, 0, 20.0, 70.0, True)]
    assert found(spark, lay("a", 2, ["other page"]), ["other"]) == []


def test_anchors(spark):
    text = "A sentence that is on the page once only. \nRate\n"
    lines = ["Rate here", "", "", "a sentence that is on the page", "once only. Rate", "", "", "", "Rate there"]
    words = spark.createDataFrame([w for w in lay("a", 1, lines) if w[3]], WORDS)
    passages = lambda t, how="text": spark.createDataFrame([("k", "a", 1, t, how)], "chunk_id string, source_doc string, page int, text string, extraction_method string")
    marks = lambda p: sorted((r.y0, r.x0, r.x1) for r in locate.highlights(p, words).collect())
    assert marks(passages(text)) == [(42.0, 0.0, 300.0), (56.0, 0.0, 90.0), (56.0, 110.0, 150.0)]
    assert len(marks(passages("Rate"))) == 3  # no anchor: all stay
    assert marks(passages(text, "ocr")) == [] and marks(passages(None)) == []


def test_pages_as_rows(spark):
    text = "A sentence that is on the page once only."
    passages = spark.createDataFrame([("k", "a", 1, text, "text")], "chunk_id string, source_doc string, page int, text string, extraction_method string")
    words = spark.createDataFrame(lay("a", 1, ["x A sentence that is", "on the page once only. y"]), WORDS)
    first, second = locate.highlights(passages, words), locate.highlights(passages, locate.paged(words))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) != []
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan  # neither pieces nor words are rows, and a page is searched once


def plain_marks(text, words):
    """Of one page: words (word, line, x0, y0, x1, y1) in order."""
    page, spans = "", []
    for i, (w, line, *box) in enumerate(words):
        w, after = w.lower(), words[i + 1][1] if i + 1 < len(words) else None
        cut = after is not None and w.endswith("-") and len(w) > 1 and after != line
        w = w[:-1] if cut else w
        spans.append((len(page), len(page) + len(w), line, box))
        page += w if cut or after is None else w + " "
    pieces = []
    for line in re.split(r"\r\n|[\r\n]", text or ""):
        line = line.strip(" \t\n\x0b\f\r")
        if 4 <= len(line) < 24 and "|" not in line:
            pieces.append((line, True))
        elif "|" in line:
            pieces += [(c.strip(" "), True) for c in line.split("|") if len(c.strip(" ")) >= 4 and set(c.strip(" ")) - set("-: ")]
        else:
            for part in re.split(r"\.(?=\s|$)", line):
                if len(part.strip(" ")) >= 24:
                    pieces += [(w, False) for w in viewer.windows(part.strip(" "))]
    hits, anchors = [], []
    for piece, cell in pieces[:60]:
        piece, own, at = " ".join(piece.lower().split()), [], 0
        while (at := page.find(piece, at)) >= 0:
            lines = {}
            for a, b, line, (x0, y0, x1, y1) in spans:
                if a < at + len(piece) and b > at:
                    left, right = x0 + (x1 - x0) * (max(a, at) - a) / (b - a), x0 + (x1 - x0) * (min(b, at + len(piece)) - a) / (b - a)
                    old = lines.get(line, (left, y0, right, y1))
                    lines[line] = (min(old[0], left), y0, max(old[2], right), y1)
            own += lines.values()
            at += len(piece)
        own.sort(key=lambda r: (r[1], r[0]))
        hits += own
        if own and not cell and all(0 <= b[1] - a[3] < 7 and b[0] < a[2] for a, b in zip(own, own[1:])):
            anchors += own
    if anchors:
        top, bottom = min(r[1] for r in anchors) - 14, max(r[3] for r in anchors) + 14
        hits = [r for r in hits if r[3] >= top and r[1] <= bottom]
    out = []
    for r in sorted(hits, key=lambda r: (r[1], r[0])):
        if out and out[-1][1] == r[1] and r[0] <= out[-1][2] + 1:
            out[-1] = (out[-1][0], r[1], max(out[-1][2], r[2]), r[3])
        else:
            out.append(r)
    return out


def test_highlights_of_documents(spark, sf):
    got = {}
    for r in queries.QUERIES["q_highlights"](spark, sf).collect():
        got.setdefault(r.chunk_id, []).append((round(r.y0, 6), round(r.x0, 6), round(r.x1, 6)))
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = [w for w in re.split(r"[ \t\r\n]+", d.text or "") if w][:400]
        laid = [(w, i // 10, i % 10 * 50.0, i // 10 * 14.0, i % 10 * 50.0 + 5 * len(w), i // 10 * 14.0 + 10) for i, w in enumerate(words)]
        want = sorted((round(y0, 6), round(x0, 6), round(x1, 6)) for x0, y0, x1, _ in plain_marks(d.text, laid))
        assert sorted(got.get(d.doc_id, [])) == want, d.doc_id
