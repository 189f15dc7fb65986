"""Checked trees: names resolved to slots, every expression typed."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessel.errors import Span
from tessel.types import DataType, Schema, Value

_NONE = Span(0, 0)


@dataclass(frozen=True)
class Literal:
    value: Value
    type: DataType | None
    span: Span = field(default=_NONE, compare=False)

    @property
    def nullable(self) -> bool:
        return self.value is None


@dataclass(frozen=True)
class Parameter:
    index: int
    type: DataType | None
    span: Span = field(default=_NONE, compare=False)
    nullable = True


@dataclass(frozen=True)
class Slot:
    """Column `column` of the `source`-th table of FROM."""

    source: int
    column: int
    name: str = field(compare=False)
    type: DataType = field(compare=False)
    nullable: bool = field(compare=False)
    span: Span = field(default=_NONE, compare=False)


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr
    type: DataType
    nullable: bool
    span: Span = field(default=_NONE, compare=False)


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    type: DataType
    nullable: bool
    span: Span = field(default=_NONE, compare=False)


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool
    span: Span = field(default=_NONE, compare=False)
    type = DataType.BOOL
    nullable = False


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Expr | None
    type: DataType
    nullable: bool
    span: Span = field(default=_NONE, compare=False)


Expr = Literal | Parameter | Slot | Unary | Binary | IsNull | Aggregate


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, (Unary, IsNull)):
        return (e.operand,)
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, Aggregate):
        return () if e.argument is None else (e.argument,)
    return ()


def walk(e: Expr):
    yield e
    for c in children(e):
        yield from walk(c)


@dataclass(frozen=True)
class ParameterSpec:
    index: int
    type: DataType
    nullable: bool
    span: Span


@dataclass(frozen=True)
class Table:
    id: int
    name: str
    schema: Schema


@dataclass(frozen=True)
class Source:
    table: Table
    alias: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Query:
    sources: tuple[Source, ...]
    joins: tuple[Expr, ...]  # condition of each source after the first
    where: Expr | None
    grouped: bool
    group_by: tuple[Expr, ...]
    output: tuple[tuple[str, Expr], ...]
    order_by: tuple[Order, ...]
    limit: Expr | None


@dataclass(frozen=True)
class CreateTable:
    name: str
    schema: Schema


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: Table
    column: int


@dataclass(frozen=True)
class Insert:
    table: Table
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Update:
    table: Table
    assignments: tuple[tuple[int, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: Table
    where: Expr | None


@dataclass(frozen=True)
class Control:
    action: str


@dataclass(frozen=True)
class Explain:
    statement: Statement


Statement = Query | CreateTable | CreateIndex | Insert | Update | Delete | Control | Explain


@dataclass(frozen=True)
class Bound:
    statement: Statement
    parameters: tuple[ParameterSpec, ...]
