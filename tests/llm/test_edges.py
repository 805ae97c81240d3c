"""Null columns, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_fp, brute_spans, brute_suffix, check_exact, check_mix, check_packing, check_pii

from corvane.llm import exact_dedup, flac, langid, mixing, packing, pii, sentence_dedup, sharding, simhash, suffix_dedup

KEY = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = "rid long, gid long, h long, g long, part int, chunk long, shard int, slot long, size long, at long, found string, spans string, class int, k int, block int, copies int, keep_id long, score string, lang_pred int, component_id long, fingerprint int, words int, root long, n long, __rid_ long"
LONG = 1_500_000


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) + (". " if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    long = text(rng, LONG // 8)
    out = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "null id " + text(rng, 60), "en", "a", 5), (4, long, "en", "b", LONG),
        (5, long, "de", "b", LONG), (5, "same id, another text", "de", "b", 1), (6, "x" * 300_000, "en", "b", 1), (7, "²½Ⅷ 12", "fr", "c", 1), (None, None, None, None, None),
    ]
    return out + [(8, "tie", "en", "a", 3)] * 3 + [(9, "t i e", "en", "a", 3), (10, "ti e ", "en", None, 3)] + [(11 + i, text(rng, 80), "en", "hot", 1) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with other columns of all sorts of names beside them."""
    plain = spark.createDataFrame(rows, KEY).repartition(3)
    return plain.select("*", *[F.lit(7).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def nulls(spark):
    """Nothing but nulls, in every column."""
    return spark.createDataFrame([(None,) * 5] * 3, KEY)


def sizes(rows):
    return Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_sharding(docs, rows, nulls):
    got = sharding.assign_shards(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == sizes(rows)
    assert len({r.shard for r in got if r["size"] > LONG // 2}) == 1  # both copies of the long text
    assert sorted(r.slot for r in sharding.assign_shards(nulls, 4).collect()) == [0, 1, 2]


def plain_shards(group_sizes, shards):
    """Capacity by trial, best fit decreasing by search, as the operator's rule says."""
    sizes, out, taken = sorted(group_sizes, reverse=True), [], 0
    total = sum(sizes)
    while sizes and taken < shards - 1 and sizes[0] * (shards - taken) > total:
        total -= sizes[0]
        out.append(sizes.pop(0))
        taken += 1
    left, best = shards - taken, None
    low = max(-(-total // left), sizes[0] if sizes else 0)
    while best is None and sizes:
        free = []
        for s in sizes:
            fits = [(f, i) for i, f in enumerate(free) if f >= s]
            if fits:
                free[min(fits)[1]] -= s
            else:
                free.append(low - s)
        best, low = ([low - f for f in free] if len(free) <= left else None), low + 1
    return sorted([*out, *(best or [])])


def test_sharding_equals_a_plain_search(spark):
    """Groups above the unit go to the plan as they are: loads are those of best fit with the least capacity."""
    rng = random.Random(3)
    texts = [f"{i:03}" + "y" * rng.randrange(20, 900) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(8)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7, units=1 << 20).collect()
    load, groups = Counter(), Counter()
    for r in got:
        load[r.shard] += r["size"]
    for _, t in rows:
        groups[t] += len(t) + 1
    assert sorted(load.values()) == plain_shards(groups.values(), 7)


def test_bundles_are_few(spark, monkeypatch):
    """However many buckets there are, all bundles but one are over half a unit."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
    rows = [(i.to_bytes(4, "big"), 1 + i % 50, 1) for i in range(2_000)]
    placed = sharding.bundle_groups(spark.createDataFrame(rows, "grp binary, gsize long, grows long"), 400).collect()
    load = Counter()
    for r in placed:
        load[r.bundle] += r.gsize
    assert len(placed) == 2_000 and max(load.values()) <= 400 and sum(v <= 200 for v in load.values()) <= 1


def test_packing(docs, rows, nulls):
    check_packing(packing.pack(docs).collect(), rows)
    assert [(r.length, r.doc_tokens) for r in packing.pack(nulls).collect()] == [(1, 1)] * 3


def plain_plan(histogram, units):
    """Every combination of up to three classes, and a least-squares fit by projected gradient."""
    combos = packing.combinations(sorted(histogram), units)
    a = np.zeros((len(histogram), len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[sorted(histogram).index(x), j] += 1
    return combos, a


def test_packing_plan_uses_no_more_than_there_is():
    rng = random.Random(4)
    histogram = {c: rng.randrange(1, 400) for c in rng.sample(range(1, 33), 20)}
    combos, a = plain_plan(histogram, 32)
    brute = {tuple(sorted(x, reverse=True)) for n in (1, 2, 3) for x in __import__("itertools").combinations_with_replacement(sorted(histogram), n) if sum(x) == 32}
    assert set(combos) == brute
    plan = packing.solve_plan(histogram, 32)
    used = Counter(c for combo, n in plan for c in combo for _ in range(n))
    assert all(used[c] <= n for c, n in histogram.items()) and all(sum(c) == 32 for c, _ in plan)
    # the fit is a minimum: no combination alone can still be added often without using up a class
    left = {c: histogram[c] - used[c] for c in histogram}
    packed, best = sum(32 * n for _, n in plan), sum(c * n for c, n in histogram.items())
    spare = max((min(left[c] // combo.count(c) for c in combo) for combo in combos), default=0)
    assert packed > 0.8 * best or spare < 0.1 * sum(histogram.values())


def test_sentence_spans(docs, rows, nulls):
    got = sentence_dedup.dedup_spans(docs).collect()
    assert Counter((r.doc_id, r.n_sentences, r.n_removed, r.kept_text) for r in got) == brute_spans(rows)
    assert [(r.n_sentences, r.kept_text) for r in sentence_dedup.dedup_spans(nulls).collect()] == [(1, "")] * 3


def test_exact(docs, rows, nulls):
    check_exact(exact_dedup.dedup_exact(docs).collect(), rows)
    got = exact_dedup.dedup_exact(nulls).collect()
    assert [r.keep_id for r in got] == [None] * 3 and sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {3}


def test_suffix(docs, rows, nulls):
    few = [r for r in rows if len(r[1] or "") < 10_000]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated(docs).collect())
    want = brute_suffix(few)
    assert sum(got.values()) == len(rows) and not want - got
    long = {k[0]: k for k in got if k[1] > 200_000}
    assert long[4][2] == 0 and long[5][2] == long[5][1] and long[6][2] == 0  # the second copy goes whole, a text never removes itself
    assert [r.n_bytes for r in suffix_dedup.remove_repeated(nulls).collect()] == [0] * 3
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeated(nulls.withColumn("doc_id", F.lit(1.5)))


def test_flac(docs, rows, nulls):
    got = flac.digest(docs).collect()
    want = Counter()
    for r in rows:
        p = flac.payload((r[1] or "").encode())
        want[r[0], len((r[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in got) == want
    assert len({r.media_sha256 for r in flac.digest(nulls).collect()}) == 1


def test_langid(spark, docs, rows, nulls):
    model = langid.train(docs, F.lit(True))
    assert [x for x, _ in model] == ["de", "en", "fr"] and len(dict(model)["de"]) < 2_000  # the long text does not fit, a shorter one is there
    alone = spark.createDataFrame([(1, "z" * 200_000 + " ende", "de", "a", 1)], KEY)
    assert [len(x) for _, x in langid.train(alone, F.lit(True))] == [200_005]  # but always one
    got = langid.classify(docs, model).collect()
    assert len(got) == len(rows) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert all(isinstance(r.score, float) and r.lang_pred != 7 for r in got)  # the input's columns of these names are replaced
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.classify(nulls, model).collect()} == {("und", 0.0, True)}
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in by_text.values())


def test_langid_does_not_see_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.withColumn("doc_id", F.lit(10_000_000) - F.col("doc_id")).withColumn("source", F.lit("s"))
    assert langid.train(docs, F.lit(True)) == langid.train(other.repartition(5), F.lit(True))


def plain_language(text, model, config=langid.LangConfig()):
    """The rule in plain steps, with zstandard on whole dictionaries for every segment."""
    import zstandard

    data = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).encode()
    if not data.strip():
        return "und"
    sizes = {}
    for lang, d in model:
        table = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=config.level, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(max(1, len(c.compress(data[i : i + config.segment_bytes])) - 6) for i in range(0, len(data), config.segment_bytes))
    first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
    return first[0] if second[1] - first[1] >= 3 * config.tie_bytes and (second[1] - first[1]) / second[1] > 2 * config.min_margin else None


def test_langid_equals_plain_compression(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    clear = 0
    for r in langid.classify(docs, model).collect():
        want = plain_language(r.text or "", model)
        clear += want is not None
        assert want in (None, r.lang_pred)
    assert clear > 150


def test_simhash(docs, rows, nulls):
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fp"), "component_id").collect()
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps, [r[0] for r in rows], 2)
    assert Counter(map(tuple, got)) == Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], comp))
    assert {(r.component_id, r.w0) for r in simhash.near_duplicates(nulls).collect()} == {(None, 0)}


def test_mixing(docs, rows, nulls):
    check_mix(mixing.mix(docs).collect(), rows)
    assert {(r["size"], r.target, r.copies) for r in mixing.mix(nulls).collect()} == {(0, 0.0, 0)}
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.MixConfig(most_sources=2))


def test_mixing_comes_near_and_splits_one_row_repeated(spark):
    """A third of all rows is one row; taken words miss the target by no more than the gap that the best single document leaves."""
    rng = random.Random(5)
    rows = [(1, "w " * 37, "hot")] * 900 + [(2 + i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "hot"])) for i in range(1_800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        assert len(r.shards) == r.copies <= 3
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    per_shard = Counter(s for r in got for s in r.shards)
    assert len(per_shard) == 16


def test_an_oversized_document_leaves_no_gap(spark):
    """One document of each source is nearly as long as the rest together: whatever block it is in, the others fill up to the target."""
    rng = random.Random(9)
    rows = []
    for source in "abcdef":
        rows += [(len(rows) + i, "w " * rng.randrange(2, 90), source) for i in range(60)] + [(len(rows) + 60, "w " * 2_500, source)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, free = Counter(), {}, defaultdict(list)
    for r in got:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        if r.copies == int(r.target // r.source_size):
            free[r.source].append(r["size"])
    assert len(target) == 6 and all(not free[s] or abs(taken[s] - t) <= min(free[s]) / 2 + 0.5 for s, t in target.items())


def test_fill_takes_the_largest_first_and_then_the_nearer():
    assert mixing.fill([5, 3, 2], [1, 4, 9], 13) == {5: 1, 3: 2, 2: 1}
    assert mixing.fill([10], [3], 6) == {10: 1} and mixing.fill([10], [3], 4) == {} and mixing.fill([], [], 4) == {}
    assert mixing.fill([4, 9], [2, 1], 16) == {9: 1, 4: 2} and mixing.fill([4, 9], [2, 1], 15) == {9: 1, 4: 1}


def plain_mix_targets(sizes, weights, most=3.0):
    """Shares by bisection on the water level."""
    total, low, high = sum(sizes), 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, most * s) for w, s in zip(weights, sizes)) < total else (low, mid)
    return [min(w * high, most * s) for w, s in zip(weights, sizes)]


def test_water_filling():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 5_000)]) for _ in range(rng.randrange(1, 9))]
        weights = [1.0 + i % 3 for i in range(len(sizes))]
        if sum(sizes):
            assert np.allclose(mixing.water_fill(sizes, weights, 3.0), plain_mix_targets(sizes, weights), rtol=1e-6, atol=1e-3)


def test_pii(docs, rows, nulls):
    got = pii.digest(pii.find_spans(docs)).collect()
    few = [r for r in rows if len(r[1] or "") < 10_000]  # the patterns themselves take quadratic time
    check_pii([r for r in got if r.doc_id not in (4, 5, 6)], [r for r in few if r[0] != 5])
    assert len(got) == len(rows) and {r.spans for r in pii.digest(pii.find_spans(nulls)).collect()} == {""}


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "(at)", "+1 ", "f:", "a.b@c.d "])
def test_pii_long_texts_take_linear_time(unit):
    t = (unit * (1_000_000 // len(unit)))[:1_000_000] + " @ ."
    began = time.process_time()
    pii.candidates(t, pii.base_spans(t))
    assert time.process_time() - began < 2.0


def planted_pii(n, seed):
    """Texts with personal data in forms that the base patterns do not know, and with look-alikes: (text, kind, span or None)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(["report", "meadow", "signal", "harbour", "ticket", "window"])

    def card():
        body = rng.choice("45") + digits(14)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    out = []
    for _ in range(n):
        c = card()
        good = rng.choice([
            ("email", f"{word()}.{word()} (at) {word()} (dot) org", "write to "), ("email", f"{word()}[at]{word()}[dot]com", "mail: "),
            ("phone", f"({rng.randrange(200, 999)}) {digits(3)}-{digits(4)}", "call "), ("phone", f"{rng.randrange(200, 999)}.{digits(3)}.{digits(4)}", "tel: "),
            ("ip", ":".join(f"{rng.randrange(1, 65_536):x}" for _ in range(8)), "server "), ("card", "/".join(c[i : i + 4] for i in (0, 4, 8, 12)), "visa "),
        ])
        bad = rng.choice([("phone", f"{digits(3)}-{digits(3)}-{digits(4)}", "isbn "), ("phone", f"000-000-{digits(1) * 4}", "order "), ("card", "/".join("1234" for _ in range(4)), "version "), ("card", "0" * 13, "id ")])
        for (kind, span, lead), is_it in ((good, True), (bad, False)):
            head = " ".join(word() for _ in range(rng.randrange(3, 9))) + " " + lead
            out.append((f"{head}{span} {word()} {word()}", kind, (len(head), len(head) + len(span)), is_it))
    base = [(f"write to {word()}{i}@{word()}.org or call +1 {digits(3)} {digits(3)} {digits(4)}, visa {card()}", "", (0, 0), False) for i in range(n // 2)]
    return out, base


def test_pii_added_spans_on_planted_data(spark):
    planted, base = planted_pii(150, 1)
    rows = [(i, t) for i, (t, *_) in enumerate([*planted, *base])]
    got = {r.doc_id: {(s.kind, s.s, s.e) for s in r.spans if not s.base} for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum((kind, *span) in got[i] for i, (_, kind, span, is_it) in enumerate(planted) if is_it)
    wrong = sum(len(got[i] - ({(kind, *span)} if is_it else set())) for i, (_, kind, span, is_it) in enumerate(planted))
    wrong += sum(len(got[len(planted) + i]) for i in range(len(base)))
    recall, precision = hit / 150, hit / max(1, hit + wrong)
    print(f"added spans: recall {recall:.2f}, precision {precision:.2f}")
    assert recall >= 0.85 and precision >= 0.85


# ---- the pipeline's stages


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stage(spark, docs, rows, nulls, name, stage):
    got = stage(spark, docs, "")
    found = got.collect()
    empty = stage(spark, docs.filter("false"), "")
    assert empty.count() == 0 and empty.columns == got.columns
    only = stage(spark, nulls, "").count()
    if name == "packing":
        check_packing(found, rows)
        assert only == 3
        return
    assert got.columns == P.COLUMNS and not {tuple(r) for r in found} - set(rows)
    texts = Counter(r.text for r in found)
    if name == "language":
        assert only == 0 and not {None, "", " \n\t ", "²½Ⅷ 12"} & set(texts) and Counter(map(tuple, found))[(8, "tie", "en", "a", 3)] in (0, 3)
    elif name == "exact_dedup":
        assert only == 1 and sum(texts[t] for t in ("tie", "t i e", "ti e ")) == 1 == texts["t i e"] and texts[rows[4][1]] == 1
        assert sum(texts[t] for t in (None, "", " \n\t ")) == 1 == texts[" \n\t "]
    elif name == "near_dedup":
        assert only == 1 and texts[rows[4][1]] == 1 and all(texts[r[1]] == 1 for r in rows[-12:])
    else:
        assert only == 0 and max(Counter(map(tuple, found)).values()) <= 9
