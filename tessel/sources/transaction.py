"""Transactions: a fixed snapshot, private writes over it, and first committer wins.

Writes stay apart until commit as staged Parquet or, for single rows, on the driver. Later
statements see them; a statement that fails takes back only its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.errors import CatalogError, ConstraintError, TransactionStateError
from tessel.operators import versioned as V
from tessel.plans.bound import Table
from tessel.sources.catalog import Catalog
from tessel.sources.store import Attempt, Outcome, Store
from tessel.types import Schema, Value, type_of

_SEQ = "_seq"


@dataclass(frozen=True)
class _Staged:
    """One statement's writes to a table: rows on the driver, or a staged folder."""

    seq: int
    rows: tuple[tuple, ...] | None = None
    path: str | None = None


class Transaction:
    def __init__(self, store: Store, read_ts: int, epoch: int, catalog: Catalog) -> None:
        self.id = uuid.uuid4().hex
        self.store, self.read_ts, self.epoch, self.catalog = store, read_ts, epoch, catalog
        self.writes: dict[int, list[_Staged]] = {}
        self.seq, self.open, self.changed_catalog = 0, True, False
        self.committed_ids = {t.id for t in catalog.tables.values()}

    # reads

    def named(self, name: str) -> Table:
        if (found := self.catalog.table(name)) is None:
            raise CatalogError(f"table `{name}` does not exist")
        return found

    def scan(self, table: Table) -> DataFrame:
        """Committed rows at the snapshot, hidden by this transaction's own writes."""
        self._check_open()
        visible = self.store.snapshot(table, self.read_ts) if table.id in self.committed_ids else self.store.spark.createDataFrame([], table.schema.spark())
        own = self._own(table)
        return visible if own is None else V.overlay(visible, own, [table.schema.key.name])

    def table(self, name: str) -> DataFrame:
        return self.scan(self.named(name))

    def get(self, name: str, key: Value) -> tuple | None:
        """The row of a key, or None."""
        table = self.named(name)
        if type_of(key) is not table.schema.key.data_type:
            raise ConstraintError(f"the key of `{table.name}` is {table.schema.key.data_type.value}")
        found = self.scan(table).filter(_is(table, key)).head(1)
        return _row(found[0]) if found else None

    def lookup(self, name: str, index: str, value: Value) -> DataFrame:
        """Rows whose indexed column equals value, by key; none for NULL. Parquet statistics narrow the scan."""
        table, found = self.named(name), self.catalog.indexes.get(index.lower())
        if found is None or found.table_id != table.id:
            raise CatalogError(f"`{index}` is no index of `{table.name}`")
        column = table.schema.columns[found.column]
        if value is not None and type_of(value) is not column.data_type:
            raise ConstraintError(f"column `{column.name}` is {column.data_type.value}")
        rows = self.scan(table).filter(F.lit(False) if value is None else F.col(f"`{column.name}`") == _lit(value))
        return rows.orderBy(table.schema.key.name)

    def _own(self, table: Table) -> DataFrame | None:
        """The last write of each key."""
        staged = self.writes.get(table.id)
        if not staged:
            return None
        schema = T.StructType([*table.schema.spark().fields, T.StructField(V.DELETED, T.BooleanType()), T.StructField(_SEQ, T.LongType())])
        rows = [(*r, s.seq) for s in staged if s.rows for r in s.rows]
        parts = [self.store.spark.createDataFrame(rows, schema)] if rows else []
        paths = [self.store.folder.at(s.path) for s in staged if s.path]
        if paths:
            parts.append(self.store.spark.read.schema(schema).parquet(*paths))
        df = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        if len(staged) > 1:
            df = V.latest(df, [table.schema.key.name], None, _SEQ)
        return df.drop(_SEQ)

    # changes

    def create_table(self, name: str, schema: Schema) -> Table:
        self._check_open()
        table = self.catalog.create_table(name, schema)
        self.changed_catalog = True
        return table

    def create_index(self, name: str, table: str, column: str) -> None:
        self._check_open()
        found = self.named(table)
        at = found.schema.position(column)
        if at is None:
            raise CatalogError(f"table `{table}` has no column `{column}`")
        self.catalog.create_index(name, found.id, at)
        self.changed_catalog = True

    def insert(self, name: str, rows: Sequence[Sequence[Value]]) -> int:
        """Adds rows; a key that is there already, or twice among them, fails."""
        table = self.named(name)
        at = table.schema.columns.index(table.schema.key)
        for r in rows:
            table.schema.check_row(r)
        keys = [r[at] for r in rows]
        if len(set(keys)) != len(keys):
            raise ConstraintError(f"a primary key of `{table.name}` is given twice")
        if keys and self.scan(table).filter(_is(table, *keys)).head(1):
            raise ConstraintError(f"a primary key of `{table.name}` exists already")
        return self._stage_rows(table, [(*r, False) for r in rows])

    def upsert(self, name: str, rows: Sequence[Sequence[Value]]) -> int:
        """Puts rows whether or not their keys exist."""
        table = self.named(name)
        for r in rows:
            table.schema.check_row(r)
        at = table.schema.columns.index(table.schema.key)
        return self._stage_rows(table, list({r[at]: (*r, False) for r in rows}.values()))

    def load(self, name: str, df: DataFrame) -> int:
        """Inserts a DataFrame of the table's columns. Keys are checked by joins; nothing comes to the driver."""
        table = self.named(name)
        columns, key = table.schema.columns, table.schema.key.name
        kinds = {f.name.lower(): f.dataType for f in df.schema}
        for c in columns:
            if kinds.get(c.name.lower()) != c.data_type.spark:
                raise ConstraintError(f"column `{c.name}` is {c.data_type.value}")
        rows = df.select(*(F.col(f"`{c.name}`") for c in columns))
        staged, n = self._stage(table, rows, False)
        written = self._staged(table, staged)
        if self._nulls(written, table, [c.name for c in columns if not c.nullable]) or written.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ConstraintError(f"a required column is NULL or a primary key of `{table.name}` is given twice")
        if self.scan(table).join(written.select(key), key, "left_semi").limit(1).count():
            raise ConstraintError(f"a primary key of `{table.name}` exists already")
        self._add(table, staged)
        return n

    def update(self, name: str, assign: Callable[[DataFrame], dict[str, Column]], where: Callable[[DataFrame], Column] | None = None) -> int:
        """Sets columns of matching rows, all from the rows as they were. Returns how many matched."""
        table = self.named(name)
        df = self.scan(table)
        values = assign(df)
        if table.schema.key.name in values:
            raise ConstraintError(f"the primary key of `{table.name}` cannot change")
        rows = df if where is None else df.filter(where(df))
        rows = rows.select(*(values.get(c.name, F.col(f"`{c.name}`")).alias(c.name) for c in table.schema.columns))
        staged, n = self._stage(table, rows, False)
        required = [c.name for c in table.schema.columns if not c.nullable and c.name in values]
        if n and self._nulls(self._staged(table, staged), table, required):
            raise ConstraintError(f"a required column of `{table.name}` cannot be NULL")
        if n:
            self._add(table, staged)
        return n

    def delete(self, name: str, where: Callable[[DataFrame], Column] | None = None) -> int:
        table = self.named(name)
        df = self.scan(table)
        staged, n = self._stage(table, df if where is None else df.filter(where(df)), True)
        if n:
            self._add(table, staged)
        return n

    def _stage_rows(self, table: Table, rows: Iterable[tuple]) -> int:
        self._check_open()
        rows = tuple(rows)
        if rows:
            self._add(table, _Staged(self.seq, rows=rows))
        return len(rows)

    def _stage(self, table: Table, rows: DataFrame, deleted: bool) -> tuple[_Staged, int]:
        self._check_open()
        path = f"staging/{self.id}/{self.seq}-{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f"`{c.name}`") for c in table.schema.columns), F.lit(deleted).alias(V.DELETED), F.lit(self.seq).cast("long").alias(_SEQ))
        rows.write.parquet(self.store.folder.at(path))
        staged = _Staged(self.seq, path=path)
        return staged, self._staged(table, staged).count()

    def _staged(self, table: Table, staged: _Staged) -> DataFrame:
        return self.store.spark.read.schema(table.schema.spark()).parquet(self.store.folder.at(str(staged.path)))

    @staticmethod
    def _nulls(rows: DataFrame, table: Table, required: Sequence[str]) -> bool:
        bad = F.lit(False)
        for c in required:
            bad = bad | F.col(f"`{c}`").isNull()
        return bool(required) and bool(rows.filter(bad).head(1))

    def _add(self, table: Table, staged: _Staged) -> None:
        self.writes.setdefault(table.id, []).append(staged)
        self.seq += 1

    # ends

    def savepoint(self) -> tuple:
        return {k: list(v) for k, v in self.writes.items()}, self.catalog.copy(), self.changed_catalog

    def back_to(self, point: tuple) -> None:
        self.writes, self.catalog, self.changed_catalog = point

    def attempt(self, client: str | None = None, sequence: int | None = None, request_hash: str = "", result: dict | None = None) -> Attempt:
        writes = {t: own for t in self.writes if (own := self._own(self.catalog.by_id(t))) is not None}
        return Attempt(self.read_ts, self.epoch, self.catalog.copy() if self.changed_catalog else None, writes, client, sequence, request_hash, result or {})

    @property
    def read_only(self) -> bool:
        return not self.changed_catalog and not any(self.writes.values())

    def commit(self, client: str | None = None, sequence: int | None = None, request_hash: str = "", result: dict | None = None) -> Outcome:
        """Publishes all writes at one commit. Without writes nothing is published and no index is used."""
        self._check_open()
        try:
            if self.read_only:
                return Outcome(self.store.state.index, True, {"affected": 0})
            return self.store.commit(self.attempt(client, sequence, request_hash, result))
        finally:
            self.end()

    def rollback(self) -> None:
        self._check_open()
        self.end()

    def end(self) -> None:
        self.open = False
        self.store.active.discard(self.id)
        if any(s.path for staged in self.writes.values() for s in staged):
            self.store.folder.delete(f"staging/{self.id}")

    def _check_open(self) -> None:
        if not self.open:
            raise TransactionStateError("the transaction has ended")


def _lit(value: Value) -> Column:
    return F.lit(bytearray(value)) if isinstance(value, (bytes, bytearray)) else F.lit(value)


def _is(table: Table, *keys: Value) -> Column:
    return F.col(f"`{table.schema.key.name}`").isin([_lit(k) for k in keys])


def _row(r) -> tuple:
    return tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r)
