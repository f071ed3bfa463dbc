"""A catalog on shared storage: tables in versioned folders, and a manifest that says which are in force.

A change writes new folders and then a new manifest, by one rename; readers see all of it or
nothing, and what they read is never overwritten. Folders and manifests go through Hadoop's
file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.schema import TABLES, VERSION, conform, ddl


class Conflict(RuntimeError):
    """Another writer committed first."""


class Catalog(Mapping[str, DataFrame]):
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: dict[str, DataFrame] | None = None
        manifest = self._latest()
        if manifest is None:
            manifest = {"commit": 0, "schema_version": VERSION, "tables": {}}
            self._write(manifest)
        self._manifest = manifest

    # Files.

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def _latest(self) -> dict | None:
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect()))

    def _write(self, manifest: dict) -> None:
        """Write a manifest under its number, by a rename that fails if the number is taken."""
        name = f"{self.path}/manifests/{manifest['commit']:012d}.json"
        fs, target = self._fs(name)
        if fs.exists(target):
            raise Conflict(name)
        _, part = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}.part")
        out = fs.create(part)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not fs.rename(part, target):
            fs.delete(part, False)
            raise Conflict(name)

    # Reading.

    def __getitem__(self, table: str) -> DataFrame:
        if self._pending is not None and table in self._pending:
            return self._pending[table]
        folder = self._manifest["tables"].get(table)
        if folder is None:
            if table not in TABLES:
                raise KeyError(table)
            return self.spark.createDataFrame([], ddl(table))
        frame = self.spark.read.parquet(f"{self.path}/{folder}")
        return conform(frame, table) if table in TABLES else frame

    def __iter__(self) -> Iterator[str]:
        return iter(sorted({*TABLES, *self._manifest["tables"]}))

    def __len__(self) -> int:
        return len({*TABLES, *self._manifest["tables"]})

    def refresh(self) -> Catalog:
        self._manifest = self._latest() or self._manifest
        return self

    @property
    def version(self) -> int:
        return self._manifest["commit"]

    def at(self, commit: int) -> Catalog:
        """The catalog as it was after a commit."""
        old = object.__new__(Catalog)
        old.spark, old.path, old._pending = self.spark, self.path, None
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{commit:012d}.json").collect())
        old._manifest = json.loads(text)
        return old

    # Writing.

    def commit(self, tables: Mapping[str, DataFrame]) -> int:
        """Put new contents in force for some tables, all at once."""
        if self._pending is not None:
            self._pending.update(tables)
            return self.version
        folders = {}
        for name, frame in tables.items():
            folder = f"tables/{name}/{uuid.uuid4().hex}"
            (conform(frame, name) if name in TABLES else frame).write.parquet(f"{self.path}/{folder}")
            folders[name] = folder
        manifest = {**self._manifest, "commit": self.version + 1, "schema_version": VERSION, "tables": {**self._manifest["tables"], **folders}}
        self._write(manifest)
        self._manifest = manifest
        return self.version

    @contextmanager
    def transaction(self) -> Iterator[Catalog]:
        """Commits inside become one; an error leaves nothing in force."""
        if self._pending is not None:
            yield self
            return
        self._pending = {}
        try:
            yield self
            pending, self._pending = self._pending, None
            if pending:
                self.commit(pending)
        finally:
            self._pending = None

    def set_meta(self, key: str, value: str) -> None:
        old = self["app_meta"].where(F.col("key") != key)
        self.commit({"app_meta": old.unionByName(self.spark.createDataFrame([(key, value)], "key string, value string"))})

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        row = self["app_meta"].where(F.col("key") == key).first()
        return row.value if row else default

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` manifests names; gives how many."""
        fs, folder = self._fs(f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        kept = {f for n in names[-keep:] for f in self.at(int(n[:12]))._manifest["tables"].values()}
        gone = 0
        for table in {f.split("/")[1] for f in kept}:
            _, place = self._fs(f"{self.path}/tables/{table}")
            for status in fs.listStatus(place):
                if f"tables/{table}/{status.getPath().getName()}" not in kept:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone
