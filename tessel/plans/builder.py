"""Queries built in Python rather than from text: filter, sort, offset and limit, then project."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import CatalogError
from tessel.functions import order_key
from tessel.plans.lower import MAX_LIMIT


@dataclass(frozen=True)
class OrderBy:
    column: str
    descending: bool = False
    nulls_first: bool = False  # whatever the direction


@dataclass(frozen=True)
class Query:
    """No projection: whole rows. Ties, and rows without an order, go by key where a limit or offset cuts."""

    filter: Column | None = None
    projection: Sequence[tuple[str, Column]] = ()
    order_by: Sequence[OrderBy] = ()
    offset: int = 0
    limit: int | None = None

    def on(self, df: DataFrame, key: str) -> DataFrame:
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise CatalogError("offset and limit cannot be negative")
        if self.filter is not None:
            df = df.filter(self.filter)
        order = [order_key(F.col(f"`{o.column}`"), o.descending, o.nulls_first) for o in self.order_by]
        if self.offset or self.limit is not None:
            order.append(F.col(f"`{key}`").asc_nulls_last())
        if order:
            df = df.orderBy(*order)
        if self.offset:
            df = df.offset(min(self.offset, MAX_LIMIT))
        if self.limit is not None:
            df = df.limit(min(self.limit, MAX_LIMIT))
        return df.select(*(c.alias(n) for n, c in self.projection)) if self.projection else df
