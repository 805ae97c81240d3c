"""WARC archives as a Spark data source, and the archiving of pages with revisit records.

Format ``corvane_warc`` reads and writes folders of ``.warc.gz`` and ``.warc``
files.  Reading: files are planned into partitions of about ``split_bytes``,
files of this writer cut at record starts that its commits list, others whole;
predicates on the record type and other headers are pushed down; of a record
the headers are inflated first, and where they fail, or where the wanted
columns need no more, the rest is skipped unread by the member's stored length
(the 'sl' extra field), inflated unkept in archives that lack it.  The payload
is decoded only where the column is asked for: name the wanted columns by
``.schema()``.  A column of another name than ``SCHEMA`` has is the header of
that name (``page_id`` reads ``Page-Id``) and can be filtered on likewise.

Writing: a task writes whole files, one gzip member a record, under a name of
their own when complete; a commit lists those of the tasks that succeeded.
Where a folder has commits only listed files are read, so what failed and
repeated attempts left is never seen.  Storage is what pyarrow opens: local
and shared folders, HDFS, S3, GCS.

Defined results of ``archive``: a null payload is empty; payloads of at least
``least`` bytes that are equal have one response, of the largest key (null
last, then the first row), and revisits of it; shorter ones are responses all;
null and repeated keys are records of their own; payloads of any length are
taken whole; an empty table is a commit without files; other columns than the
named are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.llm.common import materialize, number_rows, scratch_root, skew_join, text_or_empty

SCHEMA = "file string, offset long, warc_type string, record_id string, date string, target_uri string, refers_to string, content_type string, content_length long, payload_digest string, payload_bytes long, payload binary"
#: Headers of these columns; others are named after theirs.
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "content_type": "content-type", "content_length": "content-length", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: Bytes read of a record before its headers are judged, and inflated at a time.
PEEK = 1 << 14
BATCH_BYTES = 8 << 20
_BODY = ("payload", "payload_bytes")


class WarcError(ValueError):
    pass


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def header_name(column: str) -> str:
    return HEADERS.get(column) or column.replace("_", "-").lower()


def digest_hex(value: str | None) -> str | None:
    """'sha1:BASE32' or 'sha1:hex' as bare lower-case hex."""
    if value is None:
        return None
    body = value.split(":", 1)[-1].strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", body):
        return body.lower()
    try:
        return base64.b32decode(body.upper()).hex()
    except ValueError:
        return body


# ---- records


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as stored before compression; line ends in values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member that states its stored and its own length, where these fit."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(raw)) < 1 << 32:
        return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) + body + tail
    return b"\x1f\x8b\x08\x00" + b"\0" * 5 + b"\xff" + body + tail


def stored_length(head: bytes) -> int | None:
    """The length of the member that begins here, if it states it."""
    if len(head) < 12 or not head[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(end, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def parse_headers(raw: bytes) -> dict[str, str]:
    """Lower-case names to values; lines that continue one are joined to it, a first repeat counts."""
    out: dict[str, str] = {}
    lines = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("utf-8", "replace").splitlines()
    if not lines or not lines[0].startswith("WARC/"):
        raise WarcError(f"no record begins here: {lines[:1]}")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class _Bytes:
    """A record's bytes in order, from a gzip member or as they are, inflated as far as they are asked for."""

    def __init__(self, source: Any, at: int) -> None:
        self.source, self.at, self.next = source, at, at
        head = self._read(PEEK)
        self.empty = not head
        self.zipped = head[:2] == b"\x1f\x8b"
        self.stored = stored_length(head) if self.zipped else None
        self.z = zlib.decompressobj(31) if self.zipped else None
        self.held, self.pending, self.taken = b"", head, 0

    def _read(self, n: int) -> bytes:
        data = self.source.read_at(n, self.next)
        self.next += len(data)
        return data

    def more(self, n: int = PEEK) -> bool:
        """Holds up to n bytes more; false at the record's end or the file's."""
        if self.z is None:
            data = self.pending or self._read(n)
            self.pending = b""
            self.held += data
            return bool(data)
        while not self.z.eof:
            data = self.pending or self._read(PEEK)
            if not data:
                raise WarcError(f"the file ends inside the member at {self.at}")
            got = self.z.decompress(data, n)
            self.pending = self.z.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, start: int = 0) -> int:
        """The place of the mark; -1 where there is none."""
        while (found := self.held.find(mark, start)) < 0:
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def take(self, n: int) -> bytes:
        """The first n bytes."""
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(max(PEEK, n - have)):
                break
            parts.append(self.held)
            have += len(self.held)
        self.held = b"".join(parts)
        return self.held[:n]

    def end(self, total: int) -> int:
        """Where the next record begins; ``total`` is this one's length as it is."""
        if self.z is None:
            return self.at + total
        if self.stored is not None:
            return self.at + self.stored
        while not self.z.eof:  # no stored length: inflate, keep nothing
            self.held = b""
            if not self.more(1 << 20):
                break
        return self.next - len(self.z.unused_data)


# ---- predicates


def _number(value: str | None) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


def passes(test: Filter, value: Any) -> bool:
    """A predicate on one header's value; null is never equal, nor unequal."""
    if isinstance(test, Not):
        return value is not None and not passes(test.child, value)
    return bool(_TESTS[type(test)](value, test))


def pushable(test: Filter) -> bool:
    if isinstance(test, Not):
        return type(test.child) in (EqualTo, In, StringStartsWith, StringEndsWith, StringContains) and pushable(test.child)
    return type(test) in _TESTS and len(test.attribute) == 1 and test.attribute[0] not in _BODY


def _column(test: Filter) -> str:
    return (test.child if isinstance(test, Not) else test).attribute[0]


# ---- reading


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int]]  # path, first byte, end

    def __init__(self, parts: list[tuple[str, int, int]]) -> None:
        self.parts = parts


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[Filter] = []
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for test in filters:
            if pushable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        room = 0
        for path, size, starts in listed(self.path):
            cuts = [0]
            for s in starts:
                if s - cuts[-1] >= self.split:
                    cuts.append(s)
            for a, b in zip(cuts, [*cuts[1:], size], strict=True):
                if not out or room < b - a:
                    out.append(Ranges([]))
                    room = self.split
                out[-1].parts.append((path, a, b))
                room -= b - a
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        rows: list[dict] = []
        size = 0
        for path, first, end in partition.parts:
            system, at = _open(path)
            with system.open_input_file(at) as source:
                for row in self.records(source, path, first, end):
                    rows.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def value(self, column: str, headers: dict[str, str], path: str, at: int) -> Any:
        if column in ("file", "offset"):
            return path if column == "file" else at
        found = headers.get(header_name(column))
        if column in ("record_id", "refers_to"):
            return found and found.strip("<>")
        if column == "payload_digest":
            return digest_hex(found)
        return _number(found) if self.kinds.get(column) in ("bigint", "int") or column == "content_length" else found

    def records(self, source: Any, path: str, at: int, end: int) -> Iterator[dict]:
        while at < end:
            raw = _Bytes(source, at)
            if raw.empty:
                return
            gap = raw.until(b"\r\n\r\n")
            if gap < 0:
                if raw.held.strip(b"\r\n"):
                    raise WarcError(f"a record without headers at {at} of {path}")
                return
            headers = parse_headers(raw.held[:gap])
            length = _number(headers.get("content-length"))
            if length is None:
                raise WarcError(f"a record without a length at {at} of {path}")
            if all(passes(t, self.value(_column(t), headers, path, at)) for t in self.tests):
                row = {c: self.value(c, headers, path, at) for c in self.kinds if c not in _BODY}
                if any(c in self.kinds for c in _BODY):
                    row |= self.body(raw, headers, gap + 4, length, path)
                yield row
            at = raw.end(gap + 4 + length + 4)

    def body(self, raw: _Bytes, headers: dict[str, str], start: int, length: int, path: str) -> dict:
        """payload and its length: of an HTTP message what follows its own headers, and the length these give."""
        http = headers.get("content-type", "").startswith("application/http")
        gap, size = 0, length
        if http:
            gap = raw.until(b"\r\n\r\n", start) + 4 - start
            if gap <= 3 or gap > length:
                gap = length
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", raw.held[start : start + gap])
            size = int(said[1]) if said else length - gap
        out: dict[str, Any] = {"payload_bytes": size} if "payload_bytes" in self.kinds else {}
        if "payload" in self.kinds:
            out["payload"] = None
            if headers.get("warc-type") != "revisit":
                whole = raw.take(start + length)
                if len(whole) < start + length:
                    raise WarcError(f"the file ends inside a payload: {path}")
                out["payload"] = whole[start + gap :]
        return out


def listed(path: str) -> list[tuple[str, int, list[int]]]:
    """(path, bytes, record starts) of the folder's archives: those that its commits list, or all where there is no commit."""
    system, at = _open(path)
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
    files = {f.path: f.size for f in found if f.type == fs.FileType.File}
    commits = [f for f in files if re.search(r"/_commit-[^/]*\.json$", f)]
    if commits:
        out = []
        for commit in commits:
            with system.open_input_stream(commit) as stream:
                out += [(lead + f"{commit.rsplit('/', 1)[0]}/{x['file']}", x["bytes"], x["starts"]) for x in json.loads(stream.read())]
        return sorted(out)
    return sorted((lead + f, size, []) for f, size in files.items() if re.search(r"\.warc(\.gz)?$", f))


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Rows of warc_type, record_id, date, target_uri, payload, payload_digest, payload_bytes, refers_to; other columns become headers."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), schema.names, overwrite
        self.roll = int(options.get("roll_bytes", 1 << 30))
        self.mark = int(options.get("mark_bytes", 4 << 20))
        self.level = int(options.get("level", 6))

    def encode(self, row: dict) -> bytes:
        kind, payload = row["warc_type"], row.get("payload") or b""
        own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z")]
        if row.get("target_uri"):
            own.append(("WARC-Target-URI", row["target_uri"]))
        if row.get("payload_digest"):
            own.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
        if kind == "revisit":
            own += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
        own.append(("Content-Type", HTTP))
        known = {"payload", "payload_bytes", *HEADERS}
        own += [(c.replace("_", "-").title(), str(row[c])) for c in self.names if c not in known and row[c] is not None]
        size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        return record(own, http if kind == "revisit" else http + payload)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files: list[dict] = []
        out = name = None
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/.{name}", compression=None)
                        files.append({"file": name, "bytes": 0, "records": 0, "starts": []})
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
                        self._put(out, files[-1], member(record(info, b"format: WARC File Format 1.1\r\n"), self.level))
                    row = {c: batch.column(i)[at].as_py() for i, c in enumerate(self.names)}
                    self._put(out, files[-1], member(self.encode(row), self.level))
                    if files[-1]["bytes"] >= self.roll:
                        out.close()
                        system.move(f"{root}/.{name}", f"{root}/{name}")
                        out = None
            if out is not None:
                out.close()
                system.move(f"{root}/.{name}", f"{root}/{name}")
        except BaseException:
            if out is not None:
                out.close()
            self._drop(files)
            raise
        return Written(files)

    def _put(self, out: Any, own: dict, data: bytes) -> None:
        if own["bytes"] - (own["starts"][-1] if own["starts"] else 0) >= self.mark:
            own["starts"].append(own["bytes"])
        out.write(data)
        own["bytes"] += len(data)
        own["records"] += 1

    def _drop(self, files: list[dict]) -> None:
        system, root = _open(self.path)
        for f in files:
            for name in (f["file"], "." + f["file"]):
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("_commit-")] if self.overwrite else []
        name = f"{root}/_commit-{uuid.uuid4().hex}.json"
        with system.open_output_stream(name + ".part", compression=None) as stream:
            stream.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())
        system.move(name + ".part", name)
        for commit in old:  # the new commit is seen before the old ones go
            with system.open_input_stream(commit) as stream:
                gone = json.loads(stream.read())
            system.delete_file(commit)
            self._drop(gone)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                self._drop(m.files)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let predicates be pushed into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("corvane_warc").schema(columns).options(**options).load(path)


# ---- pages


@dataclass(frozen=True)
class ArchiveConfig:
    least: int = 1_000  # bytes from which an equal payload is a revisit
    broadcast_revisits: int = 1 << 18  # revisits, two numbers each, that go to every task; more meet their rows by a shuffle
    level: int = 6


def decide(pages: DataFrame, key: str, url: str, payload: str, config: ArchiveConfig = ArchiveConfig()) -> DataFrame:
    """Records: rid, key, target_uri, payload, payload_digest, payload_bytes, leader (of a revisit the response's rid), leader_key."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), text_or_empty(payload).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("equal", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = number_rows(rows).withColumnRenamed("__rid", "rid")
    big = rows.filter(F.col("payload_bytes") >= config.least).select("rid", "key", "equal")
    first = F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", (-F.col("rid")).alias("back"))).alias("m")
    groups = big.groupBy("equal").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select("equal", "n", (-F.col("m.back")).alias("leader"), F.col("m.key").alias("leader_key"))
    groups = materialize(groups, "warc-groups")
    revisits = skew_join(big, groups, ["equal"], "n", big.count(), ["rid"]).filter("rid <> leader").select("rid", "leader", "leader_key")
    revisits = materialize(revisits, "warc-revisits")
    small = revisits.count() <= config.broadcast_revisits
    return rows.drop("equal").join(F.broadcast(revisits) if small else revisits, "rid", "left")


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", config: ArchiveConfig = ArchiveConfig(), date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record of each page to a folder of WARC files; the headers Page-Id and Refers-To-Page-Id carry the keys."""
    rows = decide(pages, key, url, payload, config)
    urn = lambda c: F.concat(F.lit("urn:corvane:"), F.sha1(F.lit(path)), F.lit(":"), c.cast("string"))
    again = F.col("leader").isNotNull()
    out = rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), urn(F.col("rid")).alias("record_id"), F.lit(date).alias("date"), "target_uri",
        F.when(~again, F.col("payload").cast("binary")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(again, urn(F.col("leader"))).alias("refers_to"), F.col("key").cast("string").alias("page_id"), F.col("leader_key").cast("string").alias("refers_to_page_id"),
    )
    register(pages.sparkSession)
    out.write.format("corvane_warc").option("level", config.level).mode("append").save(path)


def digest(pages: DataFrame, config: ArchiveConfig = ArchiveConfig()) -> DataFrame:
    """Archives the pages, reads the archives back and checks every payload against its header: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    kind = next(f.dataType.simpleString() for f in pages.schema if f.name == "page_id")
    path = f"{scratch_root(spark)}/corvane/warc-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    archive(pages, path, config=config)
    back = read_warc(spark, path, "warc_type string, page_id string, refers_to_page_id string, payload_digest string, payload_bytes long, payload binary")
    back = back.filter(F.col("warc_type").isin("response", "revisit"))
    own = F.sha1("payload")
    sound = F.when(F.col("payload").isNull(), F.col("payload_digest")).when((own == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")), own).otherwise(F.raise_error(F.lit("a payload is not what its record says")))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", sound.alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page_id").cast(kind).alias("refers_to"))
