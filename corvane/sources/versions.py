"""Tables of immutable files under numbered versions: a change is new files and one new manifest, readers see whole versions.

A manifest is written under a name that must not exist yet, so of two writers
of one version one fails; a write that ends early leaves files that no
manifest names, and the last version as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.tables import file_system


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """A folder of parts and manifests; a part is a folder of parquet files with what its writer says about it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.system, at = file_system(spark, f"{self.root}/versions")
        self.system.mkdirs(at)

    def _path(self, name: str) -> Any:
        return file_system(self.spark, f"{self.root}/{name}")[1]

    def versions(self) -> list[int]:
        found = (s.getPath().getName() for s in self.system.listStatus(self._path("versions")))
        return sorted(int(m[1]) for name in found if (m := re.fullmatch(r"(\d{12})\.json", name)))

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """Of a version, the last by default: {"version", "parts", "info"}; version 0 is the empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "parts": [], "info": {}}
        stream = self.system.open(self._path(f"versions/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def write_part(self, frame: DataFrame, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None, **info: Any) -> dict[str, Any]:
        """Files of the rows, seen by nobody before a commit names them; ``options`` are those of the files' writer."""
        name = f"parts/{uuid.uuid4().hex}"
        frame.write.options(**(options or {})).partitionBy(*partition_by).parquet(f"{self.root}/{name}")
        return {"name": name, "schema": frame.schema.json(), **info}

    def commit(self, base: int, parts: list[dict[str, Any]], info: dict[str, Any] | None = None) -> int:
        """The next version after ``base``, of these parts."""
        version = base + 1
        body = json.dumps({"version": version, "parts": parts, "info": info or {}})
        # written aside and renamed without overwriting, so that no reader sees half a manifest
        aside = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self.system.create(aside, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        at = self._path(f"versions/{version:012d}.json")
        if self.system.exists(at) or not self.system.rename(aside, at):
            self.system.delete(aside, False)
            raise VersionConflict(f"version {version} of {self.root} exists")
        return version

    def read(self, part: dict[str, Any]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).parquet(f"{self.root}/{part['name']}")

    def table(self, version: int | None = None) -> DataFrame | None:
        """All parts of a version in one table; None where there is none."""
        out = None
        for part in self.manifest(version)["parts"]:
            rows = self.read(part)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep`` and the parts that none of these name; for when no writer is at work."""
        last = self.versions()[-keep:]
        named = {p["name"] for v in last for p in self.manifest(v)["parts"]}
        gone = list(self._unnamed(named))
        for name in gone:
            self.system.delete(self._path(name), True)
        for version in set(self.versions()) - set(last):
            self.system.delete(self._path(f"versions/{version:012d}.json"), False)
        return gone

    def _unnamed(self, named: set[str]) -> Iterator[str]:
        if self.system.exists(self._path("parts")):
            for status in self.system.listStatus(self._path("parts")):
                name = f"parts/{status.getPath().getName()}"
                if name not in named:
                    yield name
