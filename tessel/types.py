"""The four value types, table schemas and their Spark counterparts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from tessel.errors import CatalogError, ConstraintError

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
MAX_COLUMNS = 4096
MAX_VALUE_BYTES = 16 << 20
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z", re.ASCII)

Value = int | bool | str | bytes | None


class DataType(Enum):
    INT64 = "INT64"
    BOOL = "BOOL"
    TEXT = "TEXT"
    BYTES = "BYTES"

    @property
    def spark(self) -> T.DataType:
        return {DataType.INT64: T.LongType(), DataType.BOOL: T.BooleanType(), DataType.TEXT: T.StringType(), DataType.BYTES: T.BinaryType()}[self]


def type_of(value: Value) -> DataType | None:
    """The type of a value, None for NULL. There is no coercion: bool is not an integer here."""
    if value is None:
        return None
    if isinstance(value, bool):
        return DataType.BOOL
    if isinstance(value, int):
        if not INT_MIN <= value <= INT_MAX:
            raise ConstraintError(f"{value} is out of the range of INT64")
        return DataType.INT64
    if isinstance(value, str):
        return DataType.TEXT
    if isinstance(value, (bytes, bytearray)):
        return DataType.BYTES
    raise ConstraintError(f"{type(value).__name__} is not a type of this engine")


def check_size(value: Value) -> None:
    if isinstance(value, (str, bytes, bytearray)) and len(value.encode() if isinstance(value, str) else value) > MAX_VALUE_BYTES:
        raise ConstraintError(f"a value is larger than {MAX_VALUE_BYTES} bytes")


@dataclass(frozen=True)
class Column:
    name: str
    data_type: DataType
    nullable: bool = True
    primary_key: bool = False


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if not names or len(names) > MAX_COLUMNS:
            raise CatalogError(f"a table has 1 to {MAX_COLUMNS} columns")
        if not all(names) or len(set(names)) != len(names):
            raise CatalogError("column names must be unique, whatever their case, and not empty")
        if len(keys := [c for c in self.columns if c.primary_key]) != 1 or keys[0].nullable:
            raise ConstraintError("a table needs exactly one primary-key column, which is not null")

    @property
    def key(self) -> Column:
        return next(c for c in self.columns if c.primary_key)

    def position(self, name: str, exact: bool = False) -> int | None:
        for i, c in enumerate(self.columns):
            if c.name == name if exact else c.name.lower() == name.lower():
                return i
        return None

    def check_row(self, row: Sequence[Value]) -> None:
        if len(row) != len(self.columns):
            raise ConstraintError(f"a row has {len(row)} values for {len(self.columns)} columns")
        for value, column in zip(row, self.columns, strict=True):
            if (kind := type_of(value)) is None:
                if not column.nullable:
                    raise ConstraintError(f"column `{column.name}` cannot be NULL")
            elif kind is not column.data_type:
                raise ConstraintError(f"column `{column.name}` is {column.data_type.value}, not {kind.value}")
            check_size(value)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.data_type.spark, True, {"primary_key": c.primary_key}) for c in self.columns])

    def to_json(self) -> list[dict]:
        return [{"name": c.name, "type": c.data_type.value, "nullable": c.nullable, "primary_key": c.primary_key} for c in self.columns]

    @staticmethod
    def from_json(columns: list[dict]) -> Schema:
        return Schema(tuple(Column(c["name"], DataType(c["type"]), c["nullable"], c["primary_key"]) for c in columns))


def check_name(name: str) -> None:
    if not _NAME.match(name):
        raise CatalogError(f"`{name}` is no valid table or index name")
