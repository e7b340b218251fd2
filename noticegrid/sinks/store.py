"""Registry tables as versions: all tables of a version appear together, or not at all.

A version is one manifest file that names the folders of every table. Writers put their folders down
first, where nobody reads them, and then create the manifest of the next number. That file cannot be
created twice, so of two writers that started from one version the second gets ``Conflict``, and a
writer that is lost before it leaves the old version in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SEGMENTS = 64  # folders of a table that only grows, before they are written together


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _file(self, version: int):
        return self._path(f"{self.root}/manifests/{version:012d}.json")

    def version(self) -> int:
        """Number of the newest manifest; 0 for a store without one."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifests/*.json"))
        return max((int(status.getPath().getName()[:-5]) for status in found or ()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as of ``manifest``, the newest one unless given."""
        held = (manifest or self.manifest())["tables"][name]
        return self._spark.read.schema(StructType.fromJson(held["schema"])).parquet(*held["paths"])

    def write(self, name: str, rows: DataFrame) -> dict:
        """Put rows into a folder of their own; no reader sees them before ``commit``."""
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(path, compression="zstd")
        return {"schema": rows.schema.jsonValue(), "paths": [path]}

    def appended(self, name: str, rows: DataFrame, manifest: dict) -> dict:
        """A table with more rows: one folder more, or one for all where there are ``SEGMENTS``."""
        held = manifest["tables"].get(name)
        if held and len(held["paths"]) >= SEGMENTS:
            return self.write(name, self.table(name, manifest).unionByName(rows))
        fresh = self.write(name, rows)
        return {"schema": fresh["schema"], "paths": [*(held["paths"] if held else ()), *fresh["paths"]]}

    def commit(self, base: dict, tables: dict[str, dict]) -> dict:
        """The version after ``base`` with ``tables`` in place of those of the same names."""
        after = {"version": base["version"] + 1, "tables": {**base["tables"], **tables}}
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(after, sort_keys=True).encode()))
        finally:
            stream.close()
        # A rename through the file context refuses an existing target, which a plain one need not.
        jvm, gateway = self._spark.sparkContext._jvm, self._spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        try:
            context.rename(draft, self._file(after["version"]), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {after['version']} was committed by another writer") from None
            raise
        return after
