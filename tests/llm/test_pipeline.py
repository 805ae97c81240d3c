"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from test_llm_operators import brute_components, check_packing

from corvane.llm import mixing, simhash
from corvane.llm.common import materialize

KEY = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append([tuple(r) for r in docs.select(KEY).collect()])
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == KEY
        out.append([tuple(r) for r in docs.collect()])
    out.append(P.STAGES[-1][1](spark, docs, sf).collect())
    return out


def test_language_keeps_clean_documents(steps):
    before, after = steps[0], steps[1]
    assert not Counter(after) - Counter(before)
    clean = [r for r in before if r[1] and len(r[1]) > 400 and not re.search(r"(.)\1{9}", r[1])]
    assert sum(r in set(after) for r in clean) >= 0.97 * len(clean)
    assert all(re.search(r"[^\W\d_]", r[1] or "") for r in after)


def test_exact(steps):
    before, after = steps[1], steps[2]
    groups = defaultdict(list)
    for r in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0], r))
    assert Counter(after) == Counter(min(g)[2] for g in groups.values())


def test_near(steps):
    before, after = steps[2], steps[3]
    fps = [sum((w & (2**64 - 1)) << 64 * (1 - i) for i, w in enumerate(simhash.fingerprint(r[1], P.NEAR))) for r in before]
    ids = [r[0] for r in before]
    keep = set(brute_components(fps, ids, P.NEAR.radius))
    assert Counter(after) == Counter(r for r in before if r[0] in keep)


def test_mixing(steps):
    before, after = steps[3], steps[4]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    size, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        size[r[3]] += words(r)
        longest[r[3]] = max(longest[r[3]], words(r))
    for r in after:
        taken[r[3]] += words(r)
    names = sorted(size, key=lambda x: (x is None, x or ""))
    target = dict(zip(names, mixing.water_fill([size[n] for n in names], [1.0 + i % 3 for i in range(len(names))], 3.0)))
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3 * max(Counter(before).values())
    for n in names:
        assert abs(taken[n] - target[n]) <= max(0.02 * target[n], 0.5 * longest[n] + 1)


def test_packing(steps):
    rows = steps[4]
    fill, _ = check_packing(steps[5], rows)
    assert fill > 0.97


def test_run_is_the_stages(spark, sf, steps):
    got = P.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)).keys() == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in steps[5]).keys() or sum(r.length for r in got) == sum(r.length for r in steps[5])
