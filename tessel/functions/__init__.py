"""Scalar expressions with the dialect's semantics: no coercion, SQL's three-valued logic, checked integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.types import DataType, Value

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def literal(value: Value, kind: DataType | None) -> Column:
    """A typed constant; NULL takes the type that its place asks for."""
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytearray(value))
    return F.lit(value).cast((kind or DataType.TEXT).spark)


def comparison(op: str, left: Column, right: Column) -> Column:
    """NULL if either side is; operands have been checked to be of one type."""
    return _COMPARE[op](left, right)


def negate(x: Column) -> Column:
    """Fails on the least integer, whatever the session's ANSI mode."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return F.when(x == least, F.raise_error(F.lit("INT64 overflow")).cast("bigint")).otherwise(-x)


def arithmetic(op: str, left: Column, right: Column) -> Column:
    """Checked INT64 arithmetic of the query builder; division truncates. ANSI mode, which sessions
    pin, makes overflow and division by zero fail."""
    if op == "/":
        return _truncated(left, right)
    return {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right}[op]()


def _truncated(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def order_key(x: Column, descending: bool, nulls_first: bool | None = None) -> Column:
    """Ascending puts NULLs last, descending first, unless told otherwise."""
    first = descending if nulls_first is None else nulls_first
    if descending:
        return x.desc_nulls_first() if first else x.desc_nulls_last()
    return x.asc_nulls_first() if first else x.asc_nulls_last()
