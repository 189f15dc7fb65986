"""What the parser makes of a statement. Every node has its span."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessel.errors import Span
from tessel.types import DataType, Value


@dataclass(frozen=True)
class Name:
    value: str
    span: Span
    quoted: bool = False


@dataclass(frozen=True)
class Literal:
    value: Value
    span: Span


@dataclass(frozen=True)
class Parameter:
    index: int
    span: Span


@dataclass(frozen=True)
class ColumnRef:
    table: Name | None
    name: Name
    span: Span


@dataclass(frozen=True)
class Unary:
    op: str  # "-", "NOT"
    operand: Expr
    span: Span


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    span: Span


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool
    span: Span


@dataclass(frozen=True)
class Aggregate:
    function: str  # COUNT, SUM, MIN, MAX
    argument: Expr | None  # None: COUNT(*)
    span: Span


Expr = Literal | Parameter | ColumnRef | Unary | Binary | IsNull | Aggregate


@dataclass(frozen=True)
class ColumnDef:
    name: Name
    data_type: DataType
    nullable: bool
    primary_key: bool


@dataclass(frozen=True)
class CreateTable:
    name: Name
    columns: list[ColumnDef]
    span: Span


@dataclass(frozen=True)
class CreateIndex:
    name: Name
    table: Name
    column: Name
    span: Span


@dataclass(frozen=True)
class Insert:
    table: Name
    columns: list[Name] | None
    values: list[Expr]
    span: Span


@dataclass(frozen=True)
class Update:
    table: Name
    assignments: list[tuple[Name, Expr]]
    where: Expr | None
    span: Span


@dataclass(frozen=True)
class Delete:
    table: Name
    where: Expr | None
    span: Span


@dataclass(frozen=True)
class TableRef:
    name: Name
    alias: Name | None


@dataclass(frozen=True)
class SelectItem:
    expr: Expr | None  # None: *
    alias: Name | None
    span: Span


@dataclass(frozen=True)
class OrderItem:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Select:
    items: list[SelectItem]
    source: TableRef
    joins: list[tuple[TableRef, Expr]]
    where: Expr | None
    group_by: list[Expr]
    order_by: list[OrderItem]
    limit: Expr | None
    span: Span = field(default=Span(0, 0))


@dataclass(frozen=True)
class TransactionControl:
    action: str  # BEGIN, COMMIT, ROLLBACK
    span: Span


@dataclass(frozen=True)
class Explain:
    statement: Statement
    span: Span


Statement = CreateTable | CreateIndex | Insert | Update | Delete | Select | TransactionControl | Explain
