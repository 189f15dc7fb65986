"""Checked trees to DataFrames: only the declarative plan; Catalyst picks joins, pushdown and order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import Kind, SqlError
from tessel.functions import comparison, literal, negate, order_key
from tessel.plans import bound as B
from tessel.types import Value

#: Spark counts rows of a limit in 32 bits; a table beyond is not cut at all.
MAX_LIMIT = 2**31 - 1

Scan = Callable[[B.Table], DataFrame]


class Lowering:
    def __init__(self, scan: Scan, parameters: Sequence[Value] = ()) -> None:
        self.scan, self.parameters = scan, parameters
        self.known: dict[B.Expr, Column] = {}  # group keys and aggregates, once computed

    def column(self, e: B.Expr) -> Column:
        if (c := self.known.get(e)) is not None:
            return c
        match e:
            case B.Literal():
                return literal(e.value, e.type)
            case B.Parameter():
                return literal(self.parameters[e.index], e.type)
            case B.Slot():
                return F.col(slot_name(e.source, e.column))
            case B.Unary():
                operand = self.column(e.operand)
                return negate(operand) if e.op == "-" else ~operand
            case B.IsNull():
                operand = self.column(e.operand)
                return operand.isNotNull() if e.negated else operand.isNull()
            case B.Binary():
                left, right = self.column(e.left), self.column(e.right)
                if e.op in ("AND", "OR"):
                    return (left & right) if e.op == "AND" else (left | right)
                return comparison(e.op, left, right)
            case B.Aggregate():
                argument = None if e.argument is None else self.column(e.argument)
                return {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[e.function](F.lit(1) if argument is None else argument)
        raise AssertionError(e)

    def source(self, i: int, table: B.Table) -> DataFrame:
        """A table with its columns named by slot, so that no name can be mistaken for another."""
        df = self.scan(table)
        return df.select(*(F.col(f"`{c.name}`").alias(slot_name(i, j)) for j, c in enumerate(table.schema.columns)))

    def query(self, q: B.Query) -> DataFrame:
        df = self.source(0, q.sources[0].table)
        for i, on in enumerate(q.joins, 1):
            df = df.join(self.source(i, q.sources[i].table), self.column(on), "inner")
        if q.where is not None:
            df = df.filter(self.column(q.where))
        if q.grouped:
            df = self.aggregate(df, q)
        if q.limit is not None:
            # a limit needs a fixed order: ties, or all rows, go by primary key or group
            df = df.orderBy(*self.order(q), *self.ties(q))
            df = df.limit(min(self.limit(q.limit), MAX_LIMIT))
        elif q.order_by:
            df = df.orderBy(*self.order(q))
        return df.select(*(self.column(e).alias(name) for name, e in q.output))

    def order(self, q: B.Query) -> list[Column]:
        return [order_key(self.column(o.expr), o.descending) for o in q.order_by]

    def ties(self, q: B.Query) -> list[Column]:
        if q.grouped:
            return [order_key(self.column(g), False) for g in q.group_by]
        keys = [(i, s.table.schema.columns.index(s.table.schema.key)) for i, s in enumerate(q.sources)]
        return [F.col(slot_name(i, j)).asc_nulls_last() for i, j in keys]

    def aggregate(self, df: DataFrame, q: B.Query) -> DataFrame:
        wanted = [x for e in [*(e for _, e in q.output), *(o.expr for o in q.order_by)] for x in B.walk(e) if isinstance(x, B.Aggregate)]
        aggregates = list(dict.fromkeys(wanted))
        keys = [self.column(g).alias(f"g{i}") for i, g in enumerate(dict.fromkeys(q.group_by))]
        values = [self.column(a).alias(f"a{i}") for i, a in enumerate(aggregates)]
        if not q.group_by:
            df = df.agg(*values)
        elif values:
            df = df.groupBy(*keys).agg(*values)
        else:
            df = df.select(*keys).distinct()
        self.known |= {g: F.col(f"g{i}") for i, g in enumerate(dict.fromkeys(q.group_by))}
        self.known |= {a: F.col(f"a{i}") for i, a in enumerate(aggregates)}
        return df

    def limit(self, e: B.Expr) -> int:
        n = e.value if isinstance(e, B.Literal) else self.parameters[e.index]
        if not isinstance(n, int) or n < 0:
            raise SqlError(Kind.CONSTRAINT, "LIMIT cannot be negative", e.span)
        return n


def slot_name(source: int, column: int) -> str:
    return f"s{source}_{column}"
