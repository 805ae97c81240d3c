"""Every registered query against its SQL on the smallest tables."""

import hashlib
import math
import re

import duckdb
import pytest

from corvane import answer_queries, queries, report_queries  # noqa: F401 - they register
from corvane.operators import citations, viewer

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_the_others_are_compared_below():
    elsewhere = {"q_ivf_topk"}  # its recall is measured in test_vectors.py
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"q_structure_split", "q_overlap_merge", "q_citation_filter", "q_search_pieces"} | elsewhere


def plain_passages(text, size=500, overlap=50, least=200):
    """Texts without tables and headings: cut at the coarsest separator present, words counted, parts joined and overlapping."""
    marks = ["\n## ", "\n\n", "\n", " "]

    def cut(t, marks):
        use = next((m for m in marks if m in t), None)
        if use is None:
            return [t] if t.strip() else []
        finer = marks[marks.index(use) + 1 :]
        parts = [t.split(use)[0], *(use + p for p in t.split(use)[1:])]
        out, held = [], []
        for p in filter(None, parts):
            if len(p.split()) > size and finer:
                out += ["".join(held)] if held else []
                out += cut(p, finer)
                held = []
                continue
            if held and len("".join([*held, p]).split()) > size:
                out.append("".join(held))
                while held and (len("".join(held).split()) > overlap or len("".join([*held, p]).split()) > size):
                    held = held[1:]
            held.append(p)
        return out + (["".join(held)] if held else [])

    out = [p.strip() for p in cut(text, marks) if p.strip()]
    while len(out) > 1 and len(out[-1].split()) < least:
        last = out.pop()
        out[-1] += "\n" + last
    return out


def test_structure_split(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in queries.QUERIES["q_structure_split"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_type, r.location, r.digest))
    plain = {d: t for d, t in docs.items() if "|" not in t and "#" not in t}
    assert len(plain) > 100 and sum(len(v) > 1 for v in got.values()) > 10
    for d, t in plain.items():
        want = [(i, "text", None, hashlib.sha256(p.encode()).hexdigest()) for i, p in enumerate(plain_passages(t))]
        assert sorted(got.get(d, [])) == want, d


def test_overlap_merge(spark, sf):
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["q_overlap_merge"](spark, sf).collect():
        w = docs[r.doc_id]
        parts, at = [" ".join(w[:400])], 0
        while at + 400 < len(w):
            at += 350
            parts.append(" ".join(w[at : at + 400]))
        text = parts[0]
        for p in parts[1:]:
            k = max((k for k in range(20, min(len(text), len(p), 1_500) + 1) if text[-k:] == p[:k]), default=0)
            text += p[k:] if k else "\n" + p
        assert (r.windows, r.chars, r.equal) == (len(parts), len(text), text.replace("\n", " ") == " ".join(w))


def test_citation_filter(spark, sf):
    answers = {r.qid: r.answer for r in queries._answers(spark, sf).collect()}
    group = re.compile(r"\[\s*(\d+(?:\s*[,;]\s*\d+)*)\s*\]")
    numbers = lambda t: [int(n) for g in group.findall(t) for n in re.findall(r"\d+", g)]
    key = lambda n: "web" if n > 4 else ("doc", n % 2, 1 if n <= 2 else n % 2)
    for r in queries.QUERIES["q_citation_filter"](spark, sf).collect():
        answer = answers[r.qid]
        bad = sorted({n for n in numbers(answer) if not 1 <= n <= 6})
        lines = [citations.rewrite_text(x, {n: n for n in range(1, 7)}) for x in answer.split("\n")]
        lines = [re.sub(r"[ \t]+([.,;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", x)).strip() for x in lines]
        claim = lambda x: not re.match(r"\s*(#{1,6}\s|\*\*[^*]+\*\*:?\s*$)", x) and len(re.sub(group, "", x).split()) >= 8
        kept = [x for x in lines if x and (group.search(x) or not claim(x))]
        order = {}
        for n in numbers("\n".join(kept)):
            order.setdefault(key(n), len(order) + 1)
        want = citations.rewrite_text("\n".join(kept), {n: order[key(n)] for n in range(1, 7) if key(n) in order})
        assert r.invalid == ",".join(map(str, bad)) and r.n_citations == len(order) and r.removed == sum(bool(x) for x in lines) - len(kept)
        assert r.answer == (want if order else "The retrieved context doesn't support an answer to this question.")


def test_search_pieces(spark, sf):
    whole = {(r.doc_id, r.at): r.part for r in viewer.segments(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()}
    got = {}
    for r in queries.QUERIES["q_search_pieces"](spark, sf).collect():
        got.setdefault((r.doc_id, r.at), []).append((r.n, r.piece))
    assert got.keys() == whole.keys()
    for k, part in whole.items():
        pieces, words = [p for _, p in sorted(got[k])], part.split()
        assert all(len(p) <= 90 or " " not in p for p in pieces) and " ".join(pieces).split()[0] == words[0] and pieces[-1].split()[-1] == words[-1]
        at = 0  # every word is in a piece, and only the last piece reaches back
        for i, p in enumerate(pieces):
            n = len(p.split())
            start = at if i + 1 < len(pieces) else len(words) - n
            assert start <= at and p.split() == words[start : start + n]
            at = start + n
    assert viewer.windows("a" * 60 + " " + "b" * 40 + " c") == ["a" * 60, "b" * 40 + " c"] and viewer.windows("x y") == ["x y"]


def test_partition_count_does_not_matter(spark, sf):
    name = "q_rrf_fusion"
    first = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
