"""Ranked search over inverted treaps against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, num long, term string, score long, rank int, queries int, keys int"


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, x in docs if (t := split(x))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, counts, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, r in Counter(split(text)).items() if t in counts)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def documents():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("Lor", "mip", "dol", "É", "東") for b in ("em", "is", "or9", "", "ñ")]
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(n))
    bodies = [None, "", " .,;", "a", "A", "a\x00b\x7fc", "Straße İ ß", text(20_000), *[text(rng.randrange(1, 60)) for _ in range(200)], *["same words here"] * 70]
    rows = [(i if i != 9 else None, b, 1, "t", 2, 3, 4, 5) for i, b in enumerate(bodies)]
    return rows + [rows[12], rows[12], rows[20]]


def questions():
    return [(1, "lorem dolis"), (2, "same words here same"), (3, None), (4, "unknown!"), (5, "東em É A a\x00b"), (5, "Mipor9"), (6, "lorem " * 50 + "mip dol 東 Éñ"), (7, "straße i̇ ß"), (None, "c")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(4), spark.createDataFrame(questions(), "item_id long, text string")


@pytest.mark.parametrize("config", [lexical.LexicalConfig(), lexical.LexicalConfig(segment_docs=40, flat=3, narrow=1, block_queries=2), lexical.LexicalConfig(segment_postings=25, flat=1, narrow=1, broadcast_terms=1)])
def test_search_equals_brute_force(spark, tables, config):
    docs, asked = tables
    want = brute([r[:2] for r in documents()], questions())
    for index in (lexical.build(docs, config=config), lexical.build(docs, queries=asked, config=config)):
        got = sorted((tuple(r) for r in lexical.search(index, asked).collect()), key=str)
        assert got == want


def test_query_equals_brute_force_on_the_smallest_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_inverted_treaps(spark, sf).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, asked = tables
    assert lexical.search(lexical.build(docs.limit(0)), asked).collect() == []
    assert lexical.search(lexical.build(docs, queries=asked.limit(0)), asked.limit(0)).collect() == []


def test_treaps_are_heaps_in_order_of_document():
    rng = np.random.default_rng(1)
    for impacts in (rng.integers(1, 5, 400), rng.integers(1, 10**6, 400), np.ones(400, dtype=np.int64)):
        nodes = {"at": [-1], "lo": [0], "hi": [0], "top": [0], "less": [0], "more": [0]}
        root = lexical._treap(impacts, 0, len(impacts), 2, nodes)
        seen, todo, deepest = [], [(root, 0, 400, 1)], 0
        while todo:
            i, lo, hi, depth = todo.pop()
            deepest = max(deepest, depth)
            assert (nodes["lo"][i], nodes["hi"][i]) == (lo, hi) and nodes["top"][i] == impacts[lo:hi].max()
            if (at := nodes["at"][i]) < 0:
                seen += range(lo, hi)
                continue
            seen.append(at)
            todo += [(c, a, b, depth + 1) for c, a, b in ((nodes["less"][i], lo, at), (nodes["more"][i], at + 1, hi)) if a < b]
        assert sorted(seen) == list(range(400)) and deepest < 60


def test_rare_terms_prune_most_postings(spark):
    """A frequent term of low impacts in most places and of high ones in twenty documents: the walk leaves most postings unread."""
    rows = [(i, ("hit " * 9 if i % 400 == 7 else "") + ("hit " if i % 4 else "") + " ".join(f"w{(i * j) % 97}" for j in range(40 + i % 13))) for i in range(8_000)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, "hit")], "item_id long, text string")
    out = lexical.search(lexical.build(docs, queries=asked), asked, counted=True).collect()
    assert sorted(r.doc_id for r in out) == [i for i in range(8_000) if i % 400 == 7][:20]
    assert out[0].postings_read < 1_000
