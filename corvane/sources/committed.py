"""Several Parquet tables that change together: all of a commit is seen, or nothing (M18, L1, ST2).

A version is a small JSON manifest that names the files of every table. Data is written first, under names of its own;
then the manifest is put in place in one step that fails if another writer was there first. Readers hold the version
they opened, so a commit that breaks off halfway is never seen, and its files are swept later.

A table is a list of parts, and a commit writes one more: it costs what the change holds, not what the table does. In a
table with keys a later part's row stands for those of its key before. Beyond COMPACT parts the last ones are merged, as
long as the one before isn't more than twice as large as all of them, so a row is merged some log(parts) times at most.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table from which a commit merges the last ones.
COMPACT = 16


class Conflict(Exception):
    """Another writer committed the version that this one was to be."""


class Snapshot:
    """All tables as they were at one version."""

    def __init__(self, spark: SparkSession, path: str, version: int, tables: dict, batches: dict):
        self.spark, self.path, self.version, self.tables, self.batches = spark, path, version, tables, batches

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.tables[name]["schema"])

    def table(self, name: str, first: int = 0) -> DataFrame:
        """The rows of a table, or what its parts from the first given on hold."""
        held, schema = self.tables[name], self.schema(name)
        paths = [f"{self.path}/data/{name}/{part}" for part, _ in held["parts"][first:]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if not held["keys"] or len(paths) == 1:
            return self.spark.read.schema(schema).parquet(*paths)
        rows = None
        for k, path in enumerate(paths):
            part = self.spark.read.schema(schema).parquet(path).withColumn("__at", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        last = rows.groupBy(*held["keys"]).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in schema.names)), "__at").alias("__row"))
        return last.select("__row.*")


class TableSet:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        target, files = self._hadoop(f"{self.path}/versions/*.json")
        return sorted(int(f.getPath().getName()[:-5]) for f in files.globStatus(target) or [])

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest version, or one of those still there."""
        if version is None:
            version = max(self._versions(), default=-1)
        if version < 0:
            return Snapshot(self.spark, self.path, -1, {}, {})
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return Snapshot(self.spark, self.path, version, held["tables"], held["batches"])

    def create(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> int:
        """The first version. keys: of the tables that later changes are merged into; the others only grow."""
        empty = {n: {"keys": (keys or {}).get(n, []), "parts": [], "schema": df.schema.jsonValue()} for n, df in tables.items()}
        return self.commit(Snapshot(self.spark, self.path, -1, empty, {}), tables)

    def commit(self, base: Snapshot, changes: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Writes the changes upon the version that they were made from, and gives the new version.

        Rows are appended to a table without keys, and stand for those of their key in one with keys, where a change
        names a key once. batch is a stream's name and batch number: one that is in already changes nothing, so a
        replay is safe.
        """
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base.version
        after = Snapshot(self.spark, self.path, base.version, json.loads(json.dumps(base.tables)), {})
        for name, df in changes.items():
            parts = after.tables[name]["parts"]
            parts.append(self._write(df.select(*(f"`{c}`" for c in after.schema(name).names)), name))
            first = len(parts) - 1
            if len(parts) > COMPACT:
                while first and parts[first - 1][1] <= 2 * sum(n for _, n in parts[first:]):
                    first -= 1
            if first < len(parts) - 1:
                parts[first:] = [self._write(after.table(name, first), name)]
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        self._put(base.version + 1, json.dumps({"tables": after.tables, "batches": batches}))
        return base.version + 1

    def _write(self, df: DataFrame, name: str) -> tuple[str, int]:
        """A new part: its name and how many rows it has."""
        part, seen = uuid.uuid4().hex, Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}/{part}")
        return part, seen.get["n"]

    def _put(self, version: int, text: str) -> None:
        """The manifest appears whole under its number, or not at all."""
        final = f"{self.path}/versions/{version:012d}.json"
        url = urlparse(final)
        if url.scheme in ("", "file"):  # a local or mounted folder: a hard link never replaces a file
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
            own = f"{url.path}.{uuid.uuid4().hex}"
            with open(own, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, url.path)
            except FileExistsError:
                raise Conflict(final) from None
            finally:
                os.unlink(own)
            return
        target, files = self._hadoop(final)
        own, _ = self._hadoop(f"{final}.{uuid.uuid4().hex}")
        out = files.create(own)
        out.write(text.encode())
        out.close()
        if not files.rename(own, target):  # HDFS renames in one step and never onto a file
            files.delete(own, False)
            raise Conflict(final)

    def transact(self, change: Callable[[Snapshot], dict[str, DataFrame]], batch: tuple[str, int] | None = None, tries: int = 50) -> int:
        """Commits what change makes of the latest version; made anew where another writer was first."""
        for k in range(tries):
            base = self.snapshot()
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base.version
            try:
                return self.commit(base, change(base), batch)
            except Conflict:
                time.sleep(random.uniform(0, min(2.0, 0.05 * 2**k)))
        raise Conflict(f"{tries} tries on {self.path}")

    def sweep(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and data that none of those names. Not while writers are at work."""
        versions = self._versions()
        for old in versions[:-keep]:
            target, files = self._hadoop(f"{self.path}/versions/{old:012d}.json")
            files.delete(target, False)
        used = {(n, p) for v in versions[-keep:] for n, held in self.snapshot(v).tables.items() for p, _ in held["parts"]}
        target, files = self._hadoop(f"{self.path}/data/*/*")
        for status in files.globStatus(target) or []:
            path = status.getPath()
            if (path.getParent().getName(), path.getName()) not in used:
                files.delete(path, True)
