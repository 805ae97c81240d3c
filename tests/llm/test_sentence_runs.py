"""Sentence spans against brute force over all runs, not only the shortest."""

import re

import pytest
from test_llm_operators import docs, plain_units, rows, sf_rows  # noqa: F401

from corvane.llm import sentence_dedup

def brute_all_runs(rows, cfg=sentence_dedup.SpanConfig()):
    """Removes every sentence of any later copy of a run of any length, equal in its words and cuts."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        parts = plain_units(rows[i][1] or "", cfg)
        words = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", p.lower())) for p in parts]
        full = [k for k, w in enumerate(words) if w]
        gone = set()
        for a in range(len(full)):
            key = 0
            for b in range(a, len(full)):
                key = hash((key, words[full[b]]))
                if b - a + 1 >= cfg.run:
                    if key in seen:
                        gone.update(range(full[a], full[b] + 1))
                    seen.add(key)
        out.append((rows[i][0], rows[i][1], gone))
    return out


def check(got, rows):
    texts = lambda xs: sorted(xs, key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    want = texts((d, t or "", g) for d, t, g in brute_all_runs(rows))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(set(r.removed))
    for d in {x[0] for x in want}:
        mine = [g for x, _, g in want if x == d]
        assert len(mine) == len(have[d])
        # the spans' hash is over the words alone, so it may find more, never less
        assert all(a <= b for a, b in zip(sorted(mine, key=len), sorted(have[d], key=len), strict=True)), d


def sentence(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n)) + ". "


@pytest.mark.parametrize("lengths", [(15, 10, 4, 2), (4, 10, 15, 1), (25, 25, 3, 2), (19, 1, 1, 1), (1, 1, 1, 1), (60,), (9, 9, 9, 9)])
def test_a_copy_goes_to_its_last_sentence(spark, lengths):
    """Copies behind, and before, other sentences; short ones and overlong ones too."""
    text = "".join(sentence(f"t{k}w", n) for k, n in enumerate(lengths)).rstrip()
    docs = spark.createDataFrame([(1, text), (2, sentence("lead", 30) + text), (3, text + " " + sentence("end", 30).rstrip())], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in sentence_dedup.dedup_spans(docs).collect()}
    assert got[1] == text and got[2].rstrip() == sentence("lead", 30).rstrip() and got[3].lstrip() == sentence("end", 30).rstrip()


@pytest.mark.parametrize("n", [60, 200, 3_000])
def test_a_passage_without_sentence_ends_goes(spark, n):
    """Cuts follow the words, so what is left of a copied passage is less than a run at either end."""
    passage = " ".join(f"p{i * i % 7919}" for i in range(n))
    docs = spark.createDataFrame([(1, "one two three " + passage), (2, "four " + passage + " five six"), (3, passage)], "doc_id long, text string")
    config = sentence_dedup.SpanConfig()
    got = {r.doc_id: len(r.kept_text.split()) for r in sentence_dedup.dedup_spans(docs).collect()}
    assert got[1] == n + 3 and all(got[i] <= 2 * config.long_words + 3 for i in (2, 3))


def test_units_are_the_text(rows):  # noqa: F811
    config = sentence_dedup.SpanConfig()
    for row in rows:
        parts, words = sentence_dedup.units(row[1] or "", config)
        assert "".join(parts) == (row[1] or "") and parts == plain_units(row[1] or "", config)
        assert all(len(w) <= config.long_words for w in words)


def test_all_runs(docs, rows):  # noqa: F811
    check(sentence_dedup.dedup_spans(docs).collect(), rows)


def test_all_runs_sf(spark, sf, sf_rows):  # noqa: F811
    check(sentence_dedup.dedup_spans(spark.read.parquet(f"{sf}/documents.parquet")).collect(), sf_rows)
