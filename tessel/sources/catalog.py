"""Tables and indexes by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessel.errors import CatalogError
from tessel.plans.bound import Table
from tessel.types import Schema, check_name


@dataclass(frozen=True)
class Index:
    id: int
    name: str
    table_id: int
    column: int


@dataclass
class Catalog:
    """Names are unique whatever their case, over tables and indexes together. Ids count from 1.
    epoch rises by one with each commit that changes the catalog."""

    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    epoch: int = 0

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), dict(self.indexes), self.epoch)

    def table(self, name: str, exact: bool = False) -> Table | None:
        found = self.tables.get(name.lower())
        return found if found and (not exact or found.name == name) else None

    def by_id(self, table_id: int) -> Table:
        return next(t for t in self.tables.values() if t.id == table_id)

    def taken(self, name: str) -> bool:
        return name.lower() in self.tables or name.lower() in self.indexes

    def index_on(self, table_id: int, column: int) -> Index | None:
        return min((i for i in self.indexes.values() if (i.table_id, i.column) == (table_id, column)), key=lambda i: i.id, default=None)

    def create_table(self, name: str, schema: Schema) -> Table:
        self._check(name)
        table = Table(1 + max((t.id for t in self.tables.values()), default=0), name, schema)
        self.tables[name.lower()] = table
        return table

    def create_index(self, name: str, table_id: int, column: int) -> Index:
        self._check(name)
        if not 0 <= column < len(self.by_id(table_id).schema.columns):
            raise CatalogError(f"table {table_id} has no column {column}")
        index = Index(1 + max((i.id for i in self.indexes.values()), default=0), name, table_id, column)
        self.indexes[name.lower()] = index
        return index

    def _check(self, name: str) -> None:
        check_name(name)
        if self.taken(name):
            raise CatalogError(f"`{name}` exists already")

    def to_json(self) -> dict:
        return {
            "epoch": self.epoch,
            "tables": [{"id": t.id, "name": t.name, "columns": t.schema.to_json()} for t in self.tables.values()],
            "indexes": [{"id": i.id, "name": i.name, "table": i.table_id, "column": i.column} for i in self.indexes.values()],
        }

    @staticmethod
    def from_json(x: dict) -> Catalog:
        tables = [Table(t["id"], t["name"], Schema.from_json(t["columns"])) for t in x["tables"]]
        indexes = [Index(i["id"], i["name"], i["table"], i["column"]) for i in x["indexes"]]
        return Catalog({t.name.lower(): t for t in tables}, {i.name.lower(): i for i in indexes}, x["epoch"])
