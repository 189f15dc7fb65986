"""A compact tree of how a statement is answered; Spark's own plan can be shown below it."""

from __future__ import annotations

from tessel.plans import bound as B
from tessel.sources.catalog import Catalog, Index

_FLIP = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def explain(s: B.Statement, catalog: Catalog) -> str:
    match s:
        case B.Query():
            return _query(s, catalog)
        case B.CreateTable():
            return f"CreateTable name={s.name}\n"
        case B.CreateIndex():
            return f"CreateIndex name={s.name} table={s.table.name}\n"
        case B.Insert() | B.Update() | B.Delete():
            return f"{type(s).__name__} table={s.table.name}\n"
    raise AssertionError(s)


def _query(q: B.Query, catalog: Catalog) -> str:
    steps = ["Project", *["Limit"] * (q.limit is not None), *["Sort"] * bool(q.order_by), *["HashAggregate"] * q.grouped, *["Filter"] * (q.where is not None)]
    lines = [f"{'  ' * i}{step}" for i, step in enumerate(steps)]
    depth = len(lines)
    index = access_path(q.where, q.sources[0].table, catalog) if q.where is not None and len(q.sources) == 1 else None
    scan = lambda i: f"SeqScan table={q.sources[i].table.name}"
    if index is not None:
        lines.append(f"{'  ' * depth}IndexScan table={q.sources[0].table.name} index={index.name}")
    else:
        # left-deep: the last join is outermost
        for k in range(len(q.joins), 0, -1):
            lines.append(f"{'  ' * depth}Join algorithm={_join(q.joins[k - 1], k, q, catalog)}")
            depth += 1
        lines.append(f"{'  ' * depth}{scan(0)}")
        for k in range(1, len(q.sources)):
            lines.append(f"{'  ' * (depth - k + 1)}{scan(k)}")
    return "\n".join(lines) + "\n"


def _join(on: B.Expr, right: int, q: B.Query, catalog: Catalog) -> str:
    """An equality of one column of either side can be hashed; any other condition is tried on pairs."""
    if isinstance(on, B.Binary) and on.op == "=" and isinstance(on.left, B.Slot) and isinstance(on.right, B.Slot):
        inner = [s for s in (on.left, on.right) if s.source == right]
        if len(inner) == 1:
            return "IndexNestedLoop" if catalog.index_on(q.sources[right].table.id, inner[0].column) else "Hash"
    return "NestedLoop"


def access_path(where: B.Expr, table: B.Table, catalog: Catalog) -> Index | None:
    """The index of the first conjunct that compares an indexed column with a constant."""
    if isinstance(where, B.Binary) and where.op == "AND":
        return access_path(where.left, table, catalog) or access_path(where.right, table, catalog)
    if isinstance(where, B.Binary) and where.op in _FLIP:
        for column, other in ((where.left, where.right), (where.right, where.left)):
            constant = isinstance(other, B.Parameter) or (isinstance(other, B.Literal) and other.value is not None)
            if isinstance(column, B.Slot) and constant:
                return catalog.index_on(table.id, column.column)
    return None
