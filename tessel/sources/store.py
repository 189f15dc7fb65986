"""Versioned tables: Parquet version logs, published by an append-only log of commits.

A commit writes its rows, each with the commit's index, and then publishes ``commits/<index>.json``
exclusively and whole, with a digest of its body. That file is the only point of publication: rows
that no commit file names are never read, and of two writers of one index one fails. Reads name
their files by commit, so a snapshot stays what it was while others write. A last commit file that
a failed disk has torn was never answered for; it is passed over until discard_torn() removes it.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.errors import ApplyError, CatalogError, EngineError, SchemaChanged, SequenceError, SnapshotUnavailable, TransactionAborted
from tessel.operators import versioned as V
from tessel.operators.sequences import DUPLICATE, NEW, verdict
from tessel.plans.bound import Table
from tessel.sources import pinned
from tessel.sources.catalog import Catalog
from tessel.sources.files import Folder

#: A first version file with so many times the rows of all later ones is read as a base.
BASE_FACTOR = 8
MAX_ACTIVE = 4096
OUTCOMES = ("committed", "aborted", "no_op", "duplicate", "rejected")


@dataclass(frozen=True)
class VersionFile:
    """Rows that one commit wrote to one table (low = high = index), or what a vacuum kept of several."""

    table: int
    path: str
    rows: int
    low: int
    high: int
    unique_keys: bool = True


@dataclass(frozen=True)
class ClientRecord:
    sequence: int
    request_hash: str
    result: dict


@dataclass(frozen=True)
class Outcome:
    index: int
    committed: bool
    result: dict


@dataclass
class State:
    index: int = 0
    floor: int = 0
    catalog: Catalog = field(default_factory=Catalog)
    files: list[VersionFile] = field(default_factory=list)
    clients: dict[str, ClientRecord] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(OUTCOMES, 0))


@dataclass
class Attempt:
    """A transaction ready to be judged: what it read, what it changes, who asks."""

    read_ts: int
    epoch: int
    catalog: Catalog | None  # None: unchanged
    writes: dict[int, DataFrame]  # one row a key, with the tombstone flag
    client: str | None = None
    sequence: int | None = None
    request_hash: str = ""
    result: dict = field(default_factory=dict)

    def digest(self) -> str:
        """SHA-256 that equal attempts share, whatever the order in which their writes are stored:
        of the snapshot, the catalog, and for each table the number of writes and two sums of
        their rows' hashes, which Spark forms without sorting."""
        parts: list = [self.read_ts, self.epoch, self.catalog.to_json() if self.catalog else None]
        for table_id, writes in sorted(self.writes.items()):
            row = [F.col(f"`{c}`") for c in writes.columns]
            sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
            parts.append([table_id, *writes.agg(F.count("*"), *sums).first()])
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = pinned(spark)
        self.folder = Folder(spark, root)
        self.lock = threading.RLock()
        self.active: set[str] = set()
        self.state = self._recover()

    # what is on disk

    def _recover(self) -> State:
        """The newest checkpoint and all commits after it, which must be without a gap."""
        state, self.torn = State(), None
        for name in reversed([n for n in self.folder.names("checkpoints") if n.endswith(".json")]):
            state = _state_of(json.loads(self.folder.read(f"checkpoints/{name}")))
            break
        for name in self.folder.names("commits"):
            if name.endswith(".json") and int(name[:-5]) > state.index:
                entry = _entry_of(self.folder.read(f"commits/{name}"))
                if entry is None:
                    if name != max(n for n in self.folder.names("commits") if n.endswith(".json")):
                        raise EngineError(f"{name} is damaged")
                    self.torn = name
                    break
                if entry["index"] != state.index + 1:
                    raise EngineError(f"commit {state.index + 1} is missing")
                self._advance(state, entry)
        return state

    @staticmethod
    def _advance(state: State, entry: dict) -> None:
        state.index = entry["index"]
        state.counts[entry["outcome"]] += 1
        if entry.get("catalog"):
            state.catalog = Catalog.from_json(entry["catalog"])
        state.files.extend(VersionFile(**f) for f in entry["files"])
        if entry.get("client"):
            state.clients[entry["client"]] = ClientRecord(entry["sequence"], entry["request_hash"], entry["result"])

    def _publish(self, entry: dict) -> None:
        if not self.folder.create(f"commits/{entry['index']:020d}.json", _hashed(entry)):
            raise ApplyError(f"another writer has taken commit {entry['index']}; open the store again")
        self._advance(self.state, entry)

    def discard_torn(self) -> None:
        """Removes a torn last commit file, so that its index can be taken again."""
        with self.lock:
            if self.torn is not None and _entry_of(self.folder.read(f"commits/{self.torn}")) is None:
                self.folder.delete(f"commits/{self.torn}")
            self.torn = None

    # reads

    @staticmethod
    def log_schema(table: Table) -> T.StructType:
        return T.StructType([*table.schema.spark().fields, T.StructField(V.COMMIT, T.LongType()), T.StructField(V.DELETED, T.BooleanType())])

    def _read(self, table: Table, files: Sequence[VersionFile]) -> DataFrame:
        schema = self.log_schema(table)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.folder.at(f.path) for f in files))

    def files(self, table_id: int, after: int = -1, upto: int | None = None) -> list[VersionFile]:
        return [f for f in self.state.files if f.table == table_id and f.high > after and (upto is None or f.low <= upto)]

    def log(self, table: Table, after: int = -1, upto: int | None = None) -> DataFrame:
        """All versions of the table's rows that commits after `after` up to `upto` wrote."""
        files = self.files(table.id, after, upto)
        df = self._read(table, files)
        if any(f.low <= after for f in files):
            df = df.filter(F.col(V.COMMIT) > after)
        return df.filter(F.col(V.COMMIT) <= upto) if upto is not None and any(f.high > upto for f in files) else df

    def check_readable(self, read_ts: int) -> None:
        if read_ts < self.state.floor:
            raise SnapshotUnavailable(f"commit {read_ts} is below the vacuum floor {self.state.floor}")
        if read_ts > self.state.index:
            raise SnapshotUnavailable(f"commit {read_ts} is beyond the last commit {self.state.index}")

    def snapshot(self, table: Table, read_ts: int | None = None) -> DataFrame:
        """The table's visible rows at a commit. A table that one commit loaded and few have changed
        is read in place; only its changes are aggregated."""
        read_ts = self.state.index if read_ts is None else read_ts
        self.check_readable(read_ts)
        key = [table.schema.key.name]
        files = sorted(self.files(table.id, upto=read_ts), key=lambda f: f.low)
        if any(f.high > read_ts for f in files) or not files:
            return V.snapshot(self.log(table, upto=read_ts), key)
        first, later = files[0], files[1:]
        if first.unique_keys and not later:
            return self._read(table, files).filter(~F.col(V.DELETED)).drop(V.COMMIT, V.DELETED)
        if first.unique_keys and first.rows >= BASE_FACTOR * sum(f.rows for f in later):
            return V.snapshot_over_base(self._read(table, [first]), self._read(table, later), key)
        return V.snapshot(self._read(table, files), key)

    def table(self, name: str, read_ts: int | None = None) -> DataFrame:
        found = self.state.catalog.table(name)
        if found is None:
            raise CatalogError(f"table `{name}` does not exist")
        return self.snapshot(found, read_ts)

    # commits

    def begin(self, read_ts: int | None = None, epoch: int | None = None):
        """A transaction at the last commit, or at an older one that is still readable."""
        from tessel.sources.transaction import Transaction

        with self.lock:
            if len(self.active) >= MAX_ACTIVE:
                raise EngineError(f"{MAX_ACTIVE} transactions are active")
            at = self.state.index if read_ts is None else read_ts
            self.check_readable(at)
            txn = Transaction(self, at, self.state.catalog.epoch if epoch is None else epoch, self.state.catalog.copy())
            self.active.add(txn.id)
            return txn

    def _conflict(self, attempt: Attempt) -> str | None:
        if attempt.epoch != self.state.catalog.epoch:
            return "the catalog has changed since the transaction began"
        for table_id, writes in sorted(attempt.writes.items()):
            if self.files(table_id, after=attempt.read_ts):
                table = self.state.catalog.by_id(table_id)
                key = table.schema.key.name
                found = V.conflicts(writes, self.log(table, after=attempt.read_ts), [key], attempt.read_ts).orderBy(key).first()
                if found is not None:
                    return f"table `{table.name}`, key {found[key]!r}: commit {found[V.COMMIT]} came first"
        return None

    def _admission(self, attempt: Attempt) -> str:
        if attempt.client is None or attempt.sequence is None:
            return NEW
        record = self.state.clients.get(attempt.client)
        return verdict(record and record.sequence, record and record.request_hash, attempt.sequence, attempt.request_hash)

    def commit(self, attempt: Attempt) -> Outcome:
        """Admits, judges and applies an attempt at the next index, all under the lock. An abort takes
        an index too if a client asked, so that its repeat gets the same answer; a repeat gets the
        recorded answer, and a request out of sequence is refused."""
        with self.lock:
            said = self._admission(attempt)
            if said == DUPLICATE:
                self.state.counts["duplicate"] += 1
                result = self.state.clients[attempt.client].result
                if "aborted" in result:
                    raise TransactionAborted(result["aborted"])
                return Outcome(self.state.index, True, result)
            if said != NEW:
                self.state.counts["rejected"] += 1
                raise SequenceError(said, f"request {attempt.sequence} of client `{attempt.client}` is refused: {said}")
            index = self.state.index + 1
            if (why := self._conflict(attempt)) is not None:
                if attempt.client is not None:
                    self._publish(self._entry(index, "aborted", attempt, [], {"aborted": why}))
                raise (SchemaChanged if attempt.epoch != self.state.catalog.epoch else TransactionAborted)(why)
            files = []
            for table_id, writes in sorted(attempt.writes.items()):
                catalog = attempt.catalog or self.state.catalog
                columns = [c.name for c in catalog.by_id(table_id).schema.columns]
                path = f"data/{table_id}/{index}-{uuid.uuid4().hex}"
                rows = writes.select(*columns, F.lit(index).cast("long").alias(V.COMMIT), V.DELETED)
                rows.write.parquet(self.folder.at(path))
                n = self.spark.read.schema(rows.schema).parquet(self.folder.at(path)).count()
                if n:
                    files.append(VersionFile(table_id, path, n, index, index))
            if attempt.catalog is not None:
                attempt.catalog.epoch = self.state.catalog.epoch + 1
            entry = self._entry(index, "committed", attempt, files, attempt.result | {"affected": sum(f.rows for f in files)} if "affected" not in attempt.result else attempt.result)
            self._publish(entry)
            return Outcome(index, True, entry["result"])

    def _entry(self, index: int, outcome: str, a: Attempt | None, files: Iterable[VersionFile], result: dict) -> dict:
        entry = {"index": index, "outcome": outcome, "files": [asdict(f) for f in files], "result": result, "request_hash": a.request_hash if a else "", "catalog": None, "client": None}
        if a is not None:
            if outcome == "committed" and a.catalog is not None:
                entry["catalog"] = a.catalog.to_json()
            entry |= {"client": a.client, "sequence": a.sequence}
        return entry

    def apply(self, index: int, request_hash: str, attempt: Attempt | None) -> Outcome:
        """Ordered apply of a replicated or replayed log: an index that has been applied gives its
        recorded outcome, the next one is admitted and judged, others are errors. A repeated or refused
        request consumes its index and changes nothing, and so does attempt None."""
        with self.lock:
            if index <= self.state.index:
                if f"{index:020d}.json" not in self.folder.names("commits"):
                    raise ApplyError(f"index {index} is below the last checkpoint")
                entry = _entry_of(self.folder.read(f"commits/{index:020d}.json"))
                if entry is None:
                    raise EngineError(f"commit {index} is damaged")
                if entry["request_hash"] != request_hash:
                    raise ApplyError(f"index {index} was applied with another request")
                return Outcome(index, entry["outcome"] == "committed", entry["result"])
            if index != self.state.index + 1:
                raise ApplyError(f"index {self.state.index + 1} comes next, not {index}")
            if attempt is None:
                self._publish(self._entry(index, "no_op", None, [], {}) | {"request_hash": request_hash})
                return Outcome(index, False, {})
            attempt.request_hash = request_hash
            said = self._admission(attempt)
            if said != NEW:
                result = self.state.clients[attempt.client].result if said == DUPLICATE else {"rejected": said}
                self._publish(self._entry(index, "duplicate" if said == DUPLICATE else "rejected", None, [], result) | {"request_hash": request_hash})
                return Outcome(index, False, result)
            try:
                return self.commit(attempt)
            except TransactionAborted as e:
                if self.state.index < index:
                    self._publish(self._entry(index, "aborted", attempt, [], {"aborted": str(e)}))
                return Outcome(index, False, {"aborted": str(e)})

    # maintenance

    def vacuum(self, floor: int) -> None:
        """Offline: drops versions that no read at or above floor sees; older reads fail from then on."""
        with self.lock:
            if self.active:
                raise EngineError("vacuum needs that no transaction is active")
            if not self.state.floor <= floor <= self.state.index:
                raise SnapshotUnavailable(f"the floor lies between {self.state.floor} and {self.state.index}")
            files = []
            for table in self.state.catalog.tables.values():
                old = self.files(table.id)
                if not old:
                    continue
                path = f"data/{table.id}/v{floor}-{uuid.uuid4().hex}"
                V.vacuum(self.log(table), [table.schema.key.name], floor).write.parquet(self.folder.at(path))
                kept = self.spark.read.schema(self.log_schema(table)).parquet(self.folder.at(path))
                n, keys, low, high = kept.agg(F.count("*"), F.count_distinct(table.schema.key.name), F.min(V.COMMIT), F.max(V.COMMIT)).first()
                if n:
                    files.append(VersionFile(table.id, path, n, low, high, n == keys))
            gone = self.state.files
            self.state.files, self.state.floor = files, floor
            self.checkpoint()
            for f in gone:
                self.folder.delete(f.path)

    def checkpoint(self) -> None:
        """Writes the whole state, so that opening needs no commit up to here."""
        n = len(self.folder.names("checkpoints"))
        if not self.folder.create(f"checkpoints/{self.state.index:020d}-{n:06d}.json", json.dumps(_state_json(self.state))):
            raise ApplyError("another writer has written a checkpoint; open the store again")

    def export(self, path: str, read_ts: int | None = None) -> None:
        """Everything readable at and above the floor up to read_ts, with a digest of what belongs together."""
        read_ts = self.state.index if read_ts is None else read_ts
        self.check_readable(read_ts)
        out = Folder(self.spark, path)
        tables = []
        for table in self.state.catalog.tables.values():
            self.log(table, upto=read_ts).write.parquet(out.at(f"tables/{table.id}"))
            written = self.spark.read.schema(self.log_schema(table)).parquet(out.at(f"tables/{table.id}"))
            tables.append({"id": table.id, "rows": written.count(), "content": _content(written)})
        state = _state_json(self.state) | {"index": read_ts, "files": [], "tables": tables}
        body = json.dumps(state)
        out.create("snapshot.json", json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body}))

    @classmethod
    def restore(cls, spark: SparkSession, path: str, root: str) -> Store:
        """A new store from an export. A damaged or inconsistent one is refused before anything is published."""
        source = Folder(spark, path)
        outer = json.loads(source.read("snapshot.json"))
        if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
            raise EngineError("the snapshot's record is damaged")
        body = json.loads(outer["body"])
        state = _state_of(body)
        store = cls(spark, root)
        if store.state.index or store.state.catalog.tables:
            raise EngineError("the store is not new")
        if {t["id"] for t in body["tables"]} != {t.id for t in state.catalog.tables.values()}:
            raise EngineError("the snapshot's tables are not those of its catalog")
        for entry in body["tables"]:
            table = state.catalog.by_id(entry["id"])
            rows = spark.read.schema(cls.log_schema(table)).parquet(source.at(f"tables/{table.id}"))
            errors = snapshot_errors(rows, table, state.index)
            if rows.count() != entry["rows"] or errors or _content(rows) != entry["content"]:
                raise EngineError(f"table `{table.name}` of the snapshot is damaged: {errors or 'rows are missing or changed'}")
            n, keys, low, high = rows.agg(F.count("*"), F.count_distinct(table.schema.key.name), F.min(V.COMMIT), F.max(V.COMMIT)).first()
            if n:
                rows.write.parquet(store.folder.at(f"data/{table.id}/import"))
                state.files.append(VersionFile(table.id, f"data/{table.id}/import", n, low, high, n == keys))
        store.state = state
        store.checkpoint()
        return store

    # figures

    def stats(self) -> dict[str, int]:
        """Outcome counts, and versions and tombstones over all tables."""
        out = dict(self.state.counts) | {"active": len(self.active), "versions": 0, "tombstones": 0}
        for table in self.state.catalog.tables.values():
            n, dead = self.log(table).agg(F.count("*"), F.count(F.when(F.col(V.DELETED), 1))).first()
            out["versions"] += n
            out["tombstones"] += dead
        return out

    def status(self) -> dict[str, int]:
        files, size = self.folder.bytes("data")
        log_files, log_size = self.folder.bytes("commits")
        s = self.state
        return {
            "applied_index": s.index, "schema_epoch": s.catalog.epoch, "vacuum_floor": s.floor, "active_transactions": len(self.active),
            "tables": len(s.catalog.tables), "indexes": len(s.catalog.indexes), "data_files": files, "data_bytes": size,
            "commit_files": log_files, "commit_bytes": log_size,
        }


def snapshot_errors(rows: DataFrame, table: Table, index: int) -> list[str]:
    """What keeps rows from being a table's version log up to a commit."""
    key = table.schema.key.name
    out = []
    if V.key_errors(rows, [key]).limit(1).count():
        out.append("a key is null or has two versions at one commit")
    if rows.filter((F.col(V.COMMIT) > index) | (F.col(V.COMMIT) < 1) | F.col(V.COMMIT).isNull() | F.col(V.DELETED).isNull()).limit(1).count():
        out.append("a version has no commit up to the snapshot's")
    required = [c.name for c in table.schema.columns if not c.nullable and not c.primary_key]
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(f"`{c}`").isNull()
    if rows.filter(~F.col(V.DELETED) & bad).limit(1).count():
        out.append("a required column is null")
    return out


def _hashed(x: dict) -> str:
    body = json.dumps(x)
    return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})


def _entry_of(text: str) -> dict | None:
    """None for a file that was not written to its end."""
    try:
        outer = json.loads(text)
        whole = hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sha256"]
    except (ValueError, KeyError, TypeError):
        return None
    return json.loads(outer["body"]) if whole else None


def _content(rows: DataFrame) -> list[str]:
    """Two sums of the rows' hashes, whatever their order."""
    row = [F.col(f"`{c}`") for c in rows.columns]
    return list(rows.agg(*(F.coalesce(F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2))).first())


def _state_json(s: State) -> dict:
    return {
        "index": s.index, "floor": s.floor, "catalog": s.catalog.to_json(), "files": [asdict(f) for f in s.files], "counts": s.counts,
        "clients": {k: asdict(v) for k, v in s.clients.items()},
    }


def _state_of(x: dict) -> State:
    return State(x["index"], x["floor"], Catalog.from_json(x["catalog"]), [VersionFile(**f) for f in x["files"]], {k: ClientRecord(**v) for k, v in x["clients"].items()}, dict.fromkeys(OUTCOMES, 0) | x["counts"])
