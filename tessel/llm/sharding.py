"""Sharding: size-tiered compaction of immutable shards under versioned manifests.

Arrivals are written as small Parquet shards and never changed. Shards whose sizes lie within one
tier, a factor of the fan-in, are merged once there are as many as the fan-in, into files of about
the target size at most; larger tiers follow in later rounds. What the table holds is what its
newest manifest lists. A manifest is written beside its place, closed, and takes the name of the one
version after its base exclusively, so of two writers one fails and no reader sees a half-done
change. A manifest that a failed disk has damaged stops the table until recover() removes it.
Files that only swept manifests list go with them; files that none lists may be another writer's
and go when they are old. Nulls, repeated rows and rows of any length are only carried along.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessel.llm.scratch import fresh
from tessel.sources.files import Folder

#: Size of a finished file, shards of a tier that are merged, rows of an arriving shard.
TARGET_BYTES, FAN_IN, ARRIVAL_ROWS = 128 << 20, 8, 1024
BASE_BYTES = 64 << 10
#: Seconds after which a file that no manifest lists is no writer's any more.
GRACE = 24 * 3600


class CommitConflict(Exception):
    """Another writer has committed this version first."""


class DamagedManifest(Exception):
    """The newest manifest is not whole."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the table's folder
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]

    def text(self) -> str:
        body = json.dumps({"version": self.version, "schema": self.schema, "shards": [asdict(s) for s in self.shards]})
        return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @staticmethod
    def parse(text: str) -> Manifest | None:
        """None for a manifest that is not whole."""
        try:
            outer = json.loads(text)
            if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
                return None
            body = json.loads(outer["body"])
        except (ValueError, KeyError, TypeError):
            return None
        return Manifest(body["version"], body["schema"], tuple(Shard(**s) for s in body["shards"]))


def tier(size: int, fan_in: int = FAN_IN) -> int:
    """0 up to BASE_BYTES, and one more for each factor of fan_in."""
    return max(0, math.ceil(math.log(max(size, 1) / BASE_BYTES, fan_in) - 1e-9))


def plan(shards: tuple[Shard, ...], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """The merges that are due, smallest tier first: all unfinished shards of each full tier."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier(s.bytes, fan_in), []).append(s)
    return [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= fan_in]


class ShardedTable:
    """A table of shards below root, a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._folder = Folder(spark, self.root)

    def _list(self, folder: str) -> list[tuple[str, int, float]]:
        """Name, bytes and time of change of what a folder holds."""
        at = self._path(f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _, _ in self._list("manifests") if n.endswith(".json"))

    def current(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; version 0 of a new table has no shards."""
        versions = self._versions()
        if version and version not in versions:
            raise ValueError(f"no version {version}")
        v = version or max(versions, default=0)
        if not v:
            return Manifest(0, "", ())
        if (m := Manifest.parse(self._folder.read(f"manifests/{v:020d}.json"))) is None:
            raise DamagedManifest(f"version {v} is damaged")
        return m

    def recover(self) -> int:
        """Removes a newest manifest that is not whole; the version that is newest then. Its rows were
        never answered for."""
        while (versions := self._versions()) and Manifest.parse(self._folder.read(f"manifests/{versions[-1]:020d}.json")) is None:
            self._folder.delete(f"manifests/{versions[-1]:020d}.json")
        return max(self._versions(), default=0)

    def _commit(self, base: Manifest, schema: str, shards: tuple[Shard, ...]) -> Manifest:
        """Publishes the version after base, whole or not at all."""
        if (now := self.current().version) != base.version:
            raise CommitConflict(f"version {base.version} is no longer the newest, but {now}")
        new = Manifest(base.version + 1, schema, shards)
        if not self._folder.create(f"manifests/{new.version:020d}.json", new.text()):
            raise CommitConflict(f"version {new.version} is taken")
        return new

    def _write(self, df: DataFrame, rows: int | None = None) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows) if rows else df.write
        writer.parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", size) for n, size, _ in self._list(folder) if n.endswith(".parquet")]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> Manifest:
        """Adds the rows of df as small shards. Its columns must be those of the table."""
        base = self.current()
        schema = df.schema.json()
        if base.schema and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(base.schema))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the columns differ from the table's")
        return self._commit(base, base.schema or schema, base.shards + tuple(self._write(df, rows)))

    def _read(self, m: Manifest, shards: tuple[Shard, ...] | list[Shard]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.current(version)
        if not m.schema:
            raise ValueError("the table is new and has no columns yet")
        return self._read(m, m.shards)

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, sweep: bool = False) -> Manifest:
        """Merges until no tier is full; each round is one commit. sweep: drop older versions' files as it goes.

        A merge reads whole neighbouring files into as many tasks as there are files to write, so
        no row is shuffled and a task holds one row group at a time.
        """
        m = self.current()
        while due := plan(m.shards, target, fan_in):
            merged: list[Shard] = []
            for runs in due:
                size = sum(s.bytes for s in runs)
                each = min(target, fan_in * size / len(runs))
                merged += self._write(self._read(m, runs).coalesce(max(1, min(round(size / each), len(runs) // 2))))
            old = {s for runs in due for s in runs}
            m = self._commit(m, m.schema, tuple(s for s in m.shards if s not in old) + tuple(merged))
            if sweep:
                self.sweep()
        return m

    def sweep(self, keep_versions: int = 1, grace: float = GRACE) -> int:
        """Deletes manifests older than the newest keep_versions and the files that only those list;
        and files that no manifest lists, such as a lost writer's, once they are grace seconds old.
        A writer's files that it has not committed yet stay."""
        versions = self._versions()
        kept, old = versions[-keep_versions:], versions[:-keep_versions]
        listed = {s.path for v in kept for s in self.current(v).shards}
        known = {s.path for v in old for s in self.current(v).shards} - listed
        gone, before = 0, time.time() - grace
        for folder, _, _ in self._list("data"):
            files = {f"data/{folder}/{n}": t for n, _, t in self._list(f"data/{folder}") if n.endswith(".parquet")}
            free = [f for f, t in files.items() if f in known or f not in listed and t < before]
            if files and len(free) == len(files):
                gone += self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
            else:
                gone += sum(self._fs.delete(self._path(f"{self.root}/{f}"), False) for f in free)
        for v in old:
            self._folder.delete(f"manifests/{v:020d}.json")
        return gone


def op1_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive as small shards, are compacted, and are read by the last manifest."""
    table = ShardedTable(spark, fresh(spark, "shards"))
    table.append(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    table.compact(sweep=True)
    return table.read()


ORACLE_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"
