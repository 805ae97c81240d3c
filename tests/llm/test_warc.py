"""WARC source and archives against plain readers of the same bytes."""

import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import warc

SCHEMA = "page_id long, url string, html string, warc_type string, rid long, payload string, leader long"


def page_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé <>\r\n") for _ in range(n))
    shared, exact = text(1_500), "x" * 1_000
    bodies = [None, "", "short", "short", "x" * 999, "x" * 999, exact, exact, shared, shared, shared, "WARC/1.1\r\n\r\n" * 200, text(300_000)]
    bodies += [text(rng.randrange(3_000)) for _ in range(30)] + [shared] * 40
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 7 == 0 else None if i == 5 else f"http://h/{i}", b, "response", 1, "q", 2) for i, b in enumerate(bodies)]
    return rows + [rows[8], rows[8], (None, "http://n", shared, "z", 0, "", 0), (None, None, None, None, None, None, None)]


def expected(rows):
    best = {}
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= 1_000:
            best[body] = max(best.get(body, -1), -1 if page_id is None else page_id)
    out, used = [], set()
    for page_id, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        lead = best.get(body)
        again = lead is not None and (page_id != lead or body in used)
        if lead == page_id:
            used.add(body)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.archive(pages, path)
    return path


def test_digest_equals_brute_force(spark, pages):
    got = sorted((tuple(r) for r in warc.digest(pages).collect()), key=str)
    assert got == expected(page_rows())


def test_revisits_by_shuffle_and_empty_tables(spark, pages):
    got = sorted((tuple(r) for r in warc.digest(pages, warc.ArchiveConfig(broadcast_revisits=0)).collect()), key=str)
    assert got == expected(page_rows())
    assert warc.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_member_is_plain_gzip(folder):
    n = 0
    for name in (f for f in os.listdir(folder) if f.endswith(".warc.gz") and not f.startswith(".")):
        raw = open(f"{folder}/{name}", "rb").read()
        whole, at, parts = gzip.decompress(raw), 0, b""
        while at < len(raw):
            size = warc.stored_length(raw[at : at + 64])
            parts += gzip.decompress(raw[at : at + size])
            at += size
            n += 1
        assert parts == whole and whole.startswith(b"WARC/1.1\r\n")
    listing = [json.load(open(f"{folder}/{f}")) for f in os.listdir(folder) if f.startswith("_commit-")]
    assert n == sum(x["records"] for c in listing for x in c)


def test_predicates_are_pushed_and_payloads_skipped(spark, folder, monkeypatch):
    found = warc.read_warc(spark, folder, "warc_type string, page_id string").filter("warc_type = 'revisit' AND page_id LIKE '1%'")
    assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    everything = warc.read_warc(spark, folder)
    assert found.count() == everything.join(warc.read_warc(spark, folder, "file string, offset long, page_id string"), ["file", "offset"]).filter("warc_type = 'revisit' AND page_id LIKE '1%'").count() > 0
    # without payload columns the body is never inflated beyond what the headers took
    monkeypatch.setattr(warc._Bytes, "take", lambda *a: pytest.fail("a payload was decoded"))
    reader = warc.WarcReader({"path": folder}, warc.StructType.fromDDL("warc_type string, target_uri string"))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sum(r["warc_type"] == "response" for r in rows) == sum(x[3] == "response" for x in expected(page_rows()))


@pytest.mark.parametrize("test, keeps", [
    (warc.EqualTo(("c",), "b"), "b"), (warc.In(("c",), ("a", "b")), "ab"), (warc.Not(warc.EqualTo(("c",), "b")), "a"), (warc.IsNull(("c",)), "n"),
    (warc.IsNotNull(("c",)), "ab"), (warc.GreaterThan(("c",), "a"), "b"), (warc.EqualNullSafe(("c",), "a"), "a"), (warc.StringContains(("c",), "b"), "b"),
])
def test_predicates_follow_sql(test, keeps):
    assert warc.pushable(test)
    assert "".join(v or "n" for v in ("a", "b", None) if warc.passes(test, v)) == keeps
    assert not warc.pushable(warc.EqualTo(("payload",), b"")) and not warc.pushable(warc.EqualTo(("c", "d"), 1))


def test_ranges_cover_files_and_uncommitted_files_are_not_read(spark, pages, tmp_path):
    path = str(tmp_path / "b")
    warc.register(spark)
    rows = warc.decide(pages, "page_id", "url", "html").select(F.lit("response").alias("warc_type"), F.concat(F.lit("urn:x:"), F.col("rid").cast("string")).alias("record_id"), F.col("payload").cast("binary").alias("payload"), "payload_digest")
    rows.coalesce(1).write.format("corvane_warc").option("mark_bytes", 2_000).option("roll_bytes", 60_000).mode("append").save(path)
    want = rows.count()
    whole = warc.WarcReader({"path": path}, warc.StructType.fromDDL("record_id string")).partitions()
    small = warc.WarcReader({"path": path, "split_bytes": 4_000}, warc.StructType.fromDDL("record_id string")).partitions()
    assert len(small) > len(whole) == 1
    back = warc.read_warc(spark, path, "warc_type string, record_id string, payload binary, payload_digest string", split_bytes=4_000).filter("warc_type = 'response'")
    assert back.filter("sha1(payload) = payload_digest").select("record_id").distinct().count() == want
    with open(f"{path}/part-orphan.warc.gz", "wb") as f:
        f.write(b"half a mem")
    assert warc.read_warc(spark, path, "record_id string, warc_type string").filter("warc_type = 'response'").count() == want
    rows.limit(3).coalesce(1).write.format("corvane_warc").mode("overwrite").save(path)
    assert warc.read_warc(spark, path, "warc_type string").filter("warc_type = 'response'").count() == 3


def test_archives_of_others(spark, tmp_path):
    """Plain files, members without a stored length, folded headers, non-HTTP records, truncated files."""
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 26\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\nabc\r\n\r\n"
    (tmp_path / "p.warc").write_bytes(one + two)
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r.warc_type, bytes(r.payload)) for r in rows] == [("resource", b"hello"), ("response", b"\r\n\r\nabc"[:7])] + [("resource", b"hello"), ("response", b"\r\n\r\nabc"[:7]), ("resource", b"hello")]
    assert rows[0].target_uri == "http://a/ b"
    assert warc.read_warc(spark, str(tmp_path), "warc_type string").filter("warc_type = 'resource'").count() == 3
    (tmp_path / "p.warc").write_bytes((one + two)[:-20])
    with pytest.raises(Exception, match="ends inside a payload"):
        warc.read_warc(spark, str(tmp_path)).collect()
