"""The near-duplicate stage on null and repeated doc_ids."""

import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_different_texts_survive_null_and_equal_ids(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(9)]
    ids = [None, None, None, None, 7, 7, 7, 1, 2]
    rows = [(d, t, "en", "s", len(t)) for d, t in zip(ids, texts, strict=True)]
    near = texts[0].split(" ")
    near[5] = "changed"
    rows.append((3, " ".join(near), "en", "s", 1))  # of the first null row's component, and has a doc_id
    got = [tuple(r) for r in P.drop_near(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(rows[1:], key=key)
