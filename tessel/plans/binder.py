"""Resolves names, infers parameter types and checks types and grouping before anything runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from tessel.errors import ConstraintError, Kind, Span, SqlError
from tessel.plans import ast as A
from tessel.plans import bound as B
from tessel.sources.catalog import Catalog
from tessel.types import Column, DataType, Schema, Value, type_of


def bind(statement: A.Statement, catalog: Catalog) -> B.Bound:
    binder = _Binder(catalog)
    made = binder.statement(statement)
    return B.Bound(made, binder.parameters())


def check_parameters(specs: Sequence[B.ParameterSpec], values: Sequence[Value]) -> None:
    """Number, types and nullability of the values given for a statement's parameters."""
    if len(specs) != len(values):
        span = specs[-1].span if specs else Span(0, 0)
        raise SqlError(Kind.BIND, f"the statement has {len(specs)} parameters, {len(values)} values are given", span)
    for spec, value in zip(specs, values, strict=True):
        kind = type_of(value)
        if kind is None and not spec.nullable:
            raise SqlError(Kind.CONSTRAINT, f"parameter ?{spec.index + 1} cannot be NULL", spec.span)
        if kind not in (None, spec.type):
            raise SqlError(Kind.TYPE, f"parameter ?{spec.index + 1} expected {spec.type.value}, found {kind.value}", spec.span)


def _fail(kind: Kind, message: str, span: Span) -> SqlError:
    return SqlError(kind, message, span)


class _Binder:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.types: dict[int, DataType | None] = {}
        self.spans: dict[int, Span] = {}
        self.required: set[int] = set()
        self.sources: list[B.Source] = []

    def parameters(self) -> tuple[B.ParameterSpec, ...]:
        out = []
        for i in range(len(self.types)):
            if (t := self.types[i]) is None:
                raise _fail(Kind.TYPE, f"the type of parameter ?{i + 1} cannot be inferred", self.spans[i])
            out.append(B.ParameterSpec(i, t, i not in self.required, self.spans[i]))
        return tuple(out)

    # statements

    def statement(self, s: A.Statement) -> B.Statement:
        match s:
            case A.Select():
                return self.select(s)
            case A.CreateTable():
                return self.create_table(s)
            case A.CreateIndex():
                table = self.table(s.table)
                if self.catalog.taken(s.name.value):
                    raise _fail(Kind.BIND, f"`{s.name.value}` exists already", s.name.span)
                return B.CreateIndex(s.name.value, table, self.position(table, s.column))
            case A.Insert():
                return self.insert(s)
            case A.Update():
                return self.update(s)
            case A.Delete():
                table = self.only(s.table)
                return B.Delete(table, self.condition(s.where, "WHERE"))
            case A.TransactionControl():
                return B.Control(s.action)
            case A.Explain():
                return B.Explain(self.statement(s.statement))
        raise AssertionError(s)

    def create_table(self, s: A.CreateTable) -> B.CreateTable:
        if self.catalog.taken(s.name.value):
            raise _fail(Kind.BIND, f"`{s.name.value}` exists already", s.name.span)
        seen: set[str] = set()
        for c in s.columns:
            if c.name.value.lower() in seen:
                raise _fail(Kind.BIND, f"column `{c.name.value}` is given twice", c.name.span)
            seen.add(c.name.value.lower())
        try:
            schema = Schema(tuple(Column(c.name.value, c.data_type, c.nullable, c.primary_key) for c in s.columns))
        except ConstraintError as e:
            raise _fail(Kind.CONSTRAINT, str(e), s.span) from e
        return B.CreateTable(s.name.value, schema)

    def insert(self, s: A.Insert) -> B.Insert:
        table = self.table(s.table)
        columns = table.schema.columns
        at = list(range(len(columns))) if s.columns is None else [self.position(table, c) for c in s.columns]
        if len(at) != len(s.values):
            raise _fail(Kind.BIND, f"INSERT names {len(at)} columns and gives {len(s.values)} values", s.span)
        values: list[B.Expr | None] = [None] * len(columns)
        for i, (target, expr) in enumerate(zip(at, s.values, strict=True)):
            if values[target] is not None:
                name = s.columns[i] if s.columns else None
                raise _fail(Kind.BIND, f"column `{columns[target].name}` is given twice", name.span if name else s.span)
            values[target] = self.assigned(expr, columns[target])
        for i, c in enumerate(columns):
            if values[i] is None:
                if not c.nullable:
                    raise _fail(Kind.CONSTRAINT, f"INSERT omits required column `{c.name}`", s.span)
                values[i] = B.Literal(None, c.data_type)
        return B.Insert(table, tuple(v for v in values if v is not None))

    def update(self, s: A.Update) -> B.Update:
        table = self.only(s.table)
        out, seen = [], set()
        for name, expr in s.assignments:
            at = self.position(table, name)
            column = table.schema.columns[at]
            if at in seen:
                raise _fail(Kind.BIND, f"column `{column.name}` is assigned twice", name.span)
            if column.primary_key:
                raise _fail(Kind.CONSTRAINT, f"the primary-key column `{column.name}` cannot change", name.span)
            seen.add(at)
            out.append((at, self.assigned(expr, column)))
        return B.Update(table, tuple(out), self.condition(s.where, "WHERE"))

    def assigned(self, expr: A.Expr, column: Column) -> B.Expr:
        e = self.expr(expr, column.data_type)
        if not column.nullable:
            if isinstance(e, B.Parameter):
                self.required.add(e.index)
            elif isinstance(e, B.Literal) and e.value is None:
                raise _fail(Kind.CONSTRAINT, f"column `{column.name}` cannot be NULL", expr.span)
        return e

    # queries

    def select(self, s: A.Select) -> B.Query:
        self.add_source(s.source)
        joins = []
        for ref, on in s.joins:
            self.add_source(ref)
            joins.append(self.condition(on, "ON"))
        where = self.condition(s.where, "WHERE")
        group_by = tuple(self.expr(g, None) for g in s.group_by)
        for g, e in zip(s.group_by, group_by, strict=True):
            self.typed(e, g.span)
        output: list[tuple[str, B.Expr]] = []
        spans = []
        for item in s.items:
            if item.expr is None:
                for i, source in enumerate(self.sources):
                    output += [(c.name, self.slot(i, j, item.span)) for j, c in enumerate(source.table.schema.columns)]
                    spans += [item.span] * len(source.table.schema.columns)
            else:
                e = self.expr(item.expr, None, aggregates=True)
                self.typed(e, item.span)
                output.append((item.alias.value if item.alias else _name(item.expr, len(output)), e))
                spans.append(item.span)
        order_by = []
        for o in s.order_by:
            e = self.order(o.expr, output)
            self.typed(e, o.expr.span)
            order_by.append(B.Order(e, o.descending))
        output = [(n, self.settle(e)) for n, e in output]
        order_by = [replace(o, expr=self.settle(o.expr)) for o in order_by]
        group_by = tuple(self.settle(g) for g in group_by)
        grouped = bool(group_by) or any(isinstance(x, B.Aggregate) for e in [e for _, e in output] + [o.expr for o in order_by] for x in B.walk(e))
        if grouped:
            for (name, e), span in zip(output, spans, strict=True):
                if not _by_groups(e, group_by):
                    raise _fail(Kind.TYPE, f"output `{name}` has a non-grouped column outside an aggregate", span)
            for o, src in zip(order_by, s.order_by, strict=True):
                if not _by_groups(o.expr, group_by):
                    raise _fail(Kind.TYPE, "ORDER BY has a non-grouped column outside an aggregate", src.expr.span)
        return B.Query(tuple(self.sources), tuple(self.settle(j) for j in joins), self.settle(where) if where else None, grouped, group_by, tuple(output), tuple(order_by), self.limit(s.limit))

    def limit(self, e: A.Expr | None) -> B.Expr | None:
        if e is None:
            return None
        if isinstance(e, A.Parameter):
            made = self.expr(e, DataType.INT64)
            self.required.add(e.index)
            return made
        if isinstance(e, A.Literal) and type_of(e.value) is DataType.INT64:
            return B.Literal(e.value, DataType.INT64, e.span)
        raise _fail(Kind.TYPE, "LIMIT takes an INT64 literal that is not negative, or a parameter", e.span)

    def order(self, e: A.Expr, output: list[tuple[str, B.Expr]]) -> B.Expr:
        """A bare name is an output's first, then a column's."""
        if isinstance(e, A.ColumnRef) and e.table is None:
            found = [x for n, x in output if _same(n, e.name)]
            if len(found) > 1:
                raise _fail(Kind.BIND, f"ORDER BY name `{e.name.value}` is ambiguous", e.span)
            if found:
                return found[0]
        return self.expr(e, None, aggregates=True)

    # names

    def table(self, name: A.Name) -> B.Table:
        found = self.catalog.table(name.value, exact=name.quoted)
        if found is None:
            raise _fail(Kind.BIND, f"table `{name.value}` does not exist", name.span)
        return found

    def only(self, name: A.Name) -> B.Table:
        self.add_source(A.TableRef(name, None))
        return self.sources[0].table

    def add_source(self, ref: A.TableRef) -> None:
        table = self.table(ref.name)
        alias = ref.alias.value if ref.alias else table.name
        if any(x.alias.lower() == alias.lower() for x in self.sources):
            raise _fail(Kind.BIND, f"table alias `{alias}` is given twice", (ref.alias or ref.name).span)
        self.sources.append(B.Source(table, alias))

    def position(self, table: B.Table, name: A.Name) -> int:
        at = table.schema.position(name.value, exact=name.quoted)
        if at is None:
            raise _fail(Kind.BIND, f"table `{table.name}` has no column `{name.value}`", name.span)
        return at

    def slot(self, source: int, column: int, span: Span) -> B.Slot:
        c = self.sources[source].table.schema.columns[column]
        return B.Slot(source, column, c.name, c.data_type, c.nullable, span)

    def column(self, e: A.ColumnRef) -> B.Slot:
        found = []
        for i, source in enumerate(self.sources):
            if e.table is None or _same(source.alias, e.table):
                at = source.table.schema.position(e.name.value, exact=e.name.quoted)
                if at is not None:
                    found.append(self.slot(i, at, e.span))
        shown = f"{e.table.value}.{e.name.value}" if e.table else e.name.value
        if not found:
            raise _fail(Kind.BIND, f"column `{shown}` does not exist here", e.span)
        if len(found) > 1:
            raise _fail(Kind.BIND, f"column `{shown}` is ambiguous", e.span)
        return found[0]

    # expressions

    def condition(self, e: A.Expr | None, where: str) -> B.Expr | None:
        if e is None:
            return None
        made = self.expr(e, None)
        if isinstance(made, B.Parameter) and made.type is None:
            made = self.expect(made, DataType.BOOL, e.span)
        if made.type is not DataType.BOOL:
            raise _fail(Kind.TYPE, f"{where} takes a BOOL expression", e.span)
        return made

    def typed(self, e: B.Expr, span: Span) -> None:
        if isinstance(e, B.Parameter) and self.types[e.index] is None:
            raise _fail(Kind.TYPE, f"the type of parameter ?{e.index + 1} cannot be inferred", span)

    def expect(self, e: B.Expr, expected: DataType | None, span: Span) -> B.Expr:
        if expected is None:
            return e
        if isinstance(e, B.Parameter):
            known = self.types[e.index]
            if known not in (None, expected):
                raise _fail(Kind.TYPE, f"parameter ?{e.index + 1} is both {known.value} and {expected.value}", span)
            self.types[e.index] = expected
            return replace(e, type=expected)
        if e.type is None:
            return replace(e, type=expected)  # NULL
        if e.type is not expected:
            raise _fail(Kind.TYPE, f"expected {expected.value}, found {e.type.value}", span)
        return e

    def settle(self, e: B.Expr) -> B.Expr:
        """The tree with the final types of its parameters."""
        if isinstance(e, B.Parameter):
            return replace(e, type=self.types[e.index])
        if isinstance(e, (B.Unary, B.IsNull)):
            return replace(e, operand=self.settle(e.operand))
        if isinstance(e, B.Binary):
            return replace(e, left=self.settle(e.left), right=self.settle(e.right))
        if isinstance(e, B.Aggregate) and e.argument is not None:
            return replace(e, argument=self.settle(e.argument))
        return e

    def expr(self, e: A.Expr, expected: DataType | None, aggregates: bool = False, inside: bool = False) -> B.Expr:
        return self.expect(self.made(e, expected, aggregates, inside), expected, e.span)

    def made(self, e: A.Expr, expected: DataType | None, aggregates: bool, inside: bool) -> B.Expr:
        part = lambda x, t: self.expr(x, t, aggregates, inside)
        match e:
            case A.Literal():
                return B.Literal(e.value, type_of(e.value), e.span)
            case A.Parameter():
                self.types.setdefault(e.index, None)
                self.spans.setdefault(e.index, e.span)
                return B.Parameter(e.index, self.types[e.index], e.span)
            case A.ColumnRef():
                return self.column(e)
            case A.Unary():
                kind = DataType.INT64 if e.op == "-" else DataType.BOOL
                operand = part(e.operand, kind)
                return B.Unary(e.op, operand, kind, operand.nullable, e.span)
            case A.IsNull():
                operand = part(e.operand, None)
                self.typed(operand, e.operand.span)
                return B.IsNull(operand, e.negated, e.span)
            case A.Binary():
                if e.op in ("AND", "OR"):
                    left, right = part(e.left, DataType.BOOL), part(e.right, DataType.BOOL)
                else:
                    left = part(e.left, None)
                    right = self.made(e.right, left.type, aggregates, inside)
                    if left.type and right.type and left.type is not right.type:
                        if isinstance(e.right, A.Literal):
                            raise _fail(Kind.TYPE, f"expected {left.type.value}, found {right.type.value}", e.right.span)
                        raise _fail(Kind.TYPE, f"cannot compare {left.type.value} with {right.type.value}", e.span)
                    left, right = self.expect(left, right.type, e.left.span), self.expect(right, left.type, e.right.span)
                    if left.type is None and right.type is None:
                        raise _fail(Kind.TYPE, "the operand types of the comparison cannot be inferred", e.span)
                return B.Binary(e.op, left, right, DataType.BOOL, left.nullable or right.nullable, e.span)
            case A.Aggregate():
                if inside:
                    raise _fail(Kind.TYPE, "aggregates cannot be nested", e.span)
                if not aggregates:
                    raise _fail(Kind.TYPE, "aggregates are not allowed here", e.span)
                kind = DataType.INT64 if e.function == "SUM" else None
                argument = self.expr(e.argument, kind, True, True) if e.argument is not None else None
                if argument is not None:
                    self.typed(argument, e.argument.span)
                count = e.function == "COUNT"
                return B.Aggregate(e.function, argument, DataType.INT64 if count or kind else argument.type or DataType.TEXT, not count, e.span)
        raise AssertionError(e)


def _same(name: str, other: A.Name) -> bool:
    return name == other.value if other.quoted else name.lower() == other.value.lower()


def _name(e: A.Expr, position: int) -> str:
    if isinstance(e, A.ColumnRef):
        return e.name.value
    if isinstance(e, A.Aggregate):
        return e.function.lower()
    return f"expr{position + 1}"


def _by_groups(e: B.Expr, groups: tuple[B.Expr, ...]) -> bool:
    if e in groups or isinstance(e, (B.Aggregate, B.Literal, B.Parameter)):
        return True
    return not isinstance(e, B.Slot) and all(_by_groups(c, groups) for c in B.children(e))
