"""Recursive descent over tokens; expressions by binding strength."""

from __future__ import annotations

from dataclasses import replace

from tessel.errors import Kind, Span, SqlError
from tessel.plans import ast as A
from tessel.plans.lexer import Token, lex
from tessel.types import DataType

_COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
_AGGREGATES = ("COUNT", "SUM", "MIN", "MAX")
#: Words of joins that this dialect does not have; without this check they would read as aliases.
_OTHER_JOINS = frozenset({"LEFT", "RIGHT", "FULL", "NATURAL", "CROSS", "OUTER", "SEMI", "ANTI"})


def parse_statement(sql: str) -> A.Statement:
    found = parse_statements(sql)
    if len(found) != 1:
        raise SqlError(Kind.PARSE, f"one statement is expected, not {len(found)}", Span(0, len(sql.encode("utf-8", "surrogatepass"))))
    return found[0]


def parse_statements(sql: str) -> list[A.Statement]:
    p = _Parser(lex(sql))
    out = []
    while True:
        while p.take("op", ";"):
            pass
        if p.now.kind == "end":
            break
        p.parameters = 0
        out.append(p.statement())
        if p.now.kind != "end" and not p.take("op", ";"):
            raise p.error("`;` is expected between statements")
    if not out:
        raise SqlError(Kind.PARSE, "there is no statement", Span(0, p.now.span.end))
    return out


class _Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at, self.parameters = tokens, 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    @property
    def done(self) -> Span:
        return self.tokens[self.at - 1].span

    def is_(self, kind: str, *values: object) -> bool:
        return self.now.kind == kind and (not values or self.now.value in values)

    def take(self, kind: str, *values: object) -> Token | None:
        if not self.is_(kind, *values):
            return None
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, kind: str, *values: object) -> Token:
        if (t := self.take(kind, *values)) is None:
            what = " or ".join(f"`{v}`" for v in values) or f"a {kind}"
            raise self.error(f"{what} is expected, not {self.now}")
        return t

    def error(self, message: str, kind: Kind = Kind.PARSE) -> SqlError:
        return SqlError(kind, message, self.now.span)

    def word(self, *words: str) -> Token | None:
        return self.take("keyword", *words)

    def name(self) -> A.Name:
        t = self.need("name")
        return A.Name(str(t.value), t.span, t.quoted)

    def comma_list(self, one) -> list:
        out = [one()]
        while self.take("op", ","):
            out.append(one())
        return out

    # statements

    def statement(self) -> A.Statement:
        start = self.now.span
        if self.word("SELECT"):
            made: A.Statement = self.select()
        elif self.word("CREATE"):
            made = self.create()
        elif self.word("INSERT"):
            made = self.insert()
        elif self.word("UPDATE"):
            made = self.update()
        elif self.word("DELETE"):
            made = self.delete()
        elif t := self.word("BEGIN", "COMMIT", "ROLLBACK"):
            self.word("TRANSACTION")
            made = A.TransactionControl(str(t.value), start)
        elif self.word("EXPLAIN"):
            inner = self.statement()
            if isinstance(inner, (A.Explain, A.TransactionControl)):
                raise SqlError(Kind.UNSUPPORTED, "only queries and changes can be explained", inner.span)
            made = A.Explain(inner, start)
        else:
            raise self.error(f"no statement begins with {self.now}", Kind.UNSUPPORTED)
        return replace(made, span=start.join(self.done))

    def create(self) -> A.Statement:
        if self.is_("keyword", "UNIQUE"):
            raise self.error("unique indexes are not supported", Kind.UNSUPPORTED)
        if self.word("TABLE"):
            name = self.name()
            self.need("op", "(")
            columns = self.comma_list(self.column_def)
            self.need("op", ")")
            return A.CreateTable(name, columns, name.span)
        if self.word("INDEX"):
            name = self.name()
            self.need("keyword", "ON")
            table = self.name()
            self.need("op", "(")
            column = self.name()
            if self.is_("op", ","):
                raise self.error("an index has one column", Kind.UNSUPPORTED)
            self.need("op", ")")
            return A.CreateIndex(name, table, column, name.span)
        raise self.error("TABLE or INDEX is expected after CREATE")

    def column_def(self) -> A.ColumnDef:
        name = self.name()
        t = self.now
        if not self.word("INT64", "BOOL", "TEXT", "BYTES"):
            if t.kind in ("name", "keyword"):
                raise self.error(f"{t} is no type; types are INT64, BOOL, TEXT and BYTES", Kind.UNSUPPORTED)
            raise self.error("a type is expected")
        key, nullable, said = False, True, False
        while True:
            if self.word("PRIMARY"):
                self.need("keyword", "KEY")
                if key:
                    raise self.error("PRIMARY KEY is given twice")
                key = True
            elif self.is_("keyword", "NOT", "NULL"):
                if said:
                    raise self.error("nullability is given twice")
                said, nullable = True, not self.word("NOT")
                self.need("keyword", "NULL")
            else:
                break
        if key and said and nullable:
            raise SqlError(Kind.CONSTRAINT, f"the primary-key column `{name.value}` cannot be NULL", name.span)
        return A.ColumnDef(name, DataType(str(t.value)), nullable and not key, key)

    def insert(self) -> A.Insert:
        self.need("keyword", "INTO")
        table, columns = self.name(), None
        if self.take("op", "("):
            columns = self.comma_list(self.name)
            self.need("op", ")")
        self.need("keyword", "VALUES")
        self.need("op", "(")
        values = self.comma_list(self.expression)
        self.need("op", ")")
        if self.is_("op", ","):
            raise self.error("INSERT takes one row", Kind.UNSUPPORTED)
        return A.Insert(table, columns, values, table.span)

    def update(self) -> A.Update:
        table = self.name()
        self.need("keyword", "SET")

        def assignment() -> tuple[A.Name, A.Expr]:
            column = self.name()
            self.need("op", "=")
            return column, self.expression()

        return A.Update(table, self.comma_list(assignment), self.where(), table.span)

    def delete(self) -> A.Delete:
        self.need("keyword", "FROM")
        table = self.name()
        return A.Delete(table, self.where(), table.span)

    def where(self) -> A.Expr | None:
        return self.expression() if self.word("WHERE") else None

    def select(self) -> A.Select:
        items = self.comma_list(self.select_item)
        self.need("keyword", "FROM")
        source, joins = self.table_ref(), []
        while True:
            if self.word("INNER"):
                self.need("keyword", "JOIN")
            elif not self.word("JOIN"):
                break
            table = self.table_ref()
            self.need("keyword", "ON")
            joins.append((table, self.expression()))
        where, group_by, order_by, limit = self.where(), [], [], None
        if self.word("GROUP"):
            self.need("keyword", "BY")
            group_by = self.comma_list(self.expression)
        if self.word("ORDER"):
            self.need("keyword", "BY")
            order_by = self.comma_list(self.order_item)
        if self.word("LIMIT"):
            limit = self.expression()
        return A.Select(items, source, joins, where, group_by, order_by, limit)

    def select_item(self) -> A.SelectItem:
        if t := self.take("op", "*"):
            return A.SelectItem(None, None, t.span)
        expr = self.expression()
        alias = self.name() if self.word("AS") else None
        return A.SelectItem(expr, alias, expr.span)

    def table_ref(self) -> A.TableRef:
        name = self.name()
        if self.word("AS"):
            return A.TableRef(name, self.name())
        if self.is_("name"):
            if not self.now.quoted and str(self.now.value).upper() in _OTHER_JOINS:
                raise self.error(f"{self.now} joins are not supported", Kind.UNSUPPORTED)
            return A.TableRef(name, self.name())
        return A.TableRef(name, None)

    def order_item(self) -> A.OrderItem:
        expr = self.expression()
        t = self.word("ASC", "DESC")
        return A.OrderItem(expr, t is not None and t.value == "DESC")

    # expressions, loosest first

    def expression(self) -> A.Expr:
        return self.chain("OR", lambda: self.chain("AND", self.negation))

    def chain(self, op: str, part) -> A.Expr:
        left = part()
        while self.word(op):
            right = part()
            left = A.Binary(op, left, right, left.span.join(right.span))
        return left

    def negation(self) -> A.Expr:
        if t := self.word("NOT"):
            operand = self.negation()
            return A.Unary("NOT", operand, t.span.join(operand.span))
        return self.comparison()

    def comparison(self) -> A.Expr:
        left = self.minus()
        if self.word("IS"):
            negated = self.word("NOT") is not None
            self.need("keyword", "NULL")
            left = A.IsNull(left, negated, left.span.join(self.done))
        elif t := self.take("op", *_COMPARISONS):
            right = self.minus()
            left = A.Binary(str(t.value), left, right, left.span.join(right.span))
        if self.is_("op", *_COMPARISONS) or self.is_("keyword", "IS"):
            raise self.error("comparisons cannot be chained without parentheses")
        return left

    def minus(self) -> A.Expr:
        if t := self.take("op", "-"):
            operand = self.minus()
            return A.Unary("-", operand, t.span.join(operand.span))
        return self.primary()

    def primary(self) -> A.Expr:
        t = self.now
        if self.take("literal"):
            return A.Literal(t.value, t.span)  # type: ignore[arg-type]
        if self.word("TRUE", "FALSE", "NULL"):
            return A.Literal({"TRUE": True, "FALSE": False, "NULL": None}[str(t.value)], t.span)
        if self.take("op", "?"):
            self.parameters += 1
            return A.Parameter(self.parameters - 1, t.span)
        if self.take("op", "("):
            inner = self.expression()
            self.need("op", ")")
            return inner
        if self.word(*_AGGREGATES):
            self.need("op", "(")
            if self.is_("op", "*") and t.value == "COUNT":
                self.need("op", "*")
                argument = None
            else:
                argument = self.expression()
            self.need("op", ")")
            return A.Aggregate(str(t.value), argument, t.span.join(self.done))
        if t.kind == "name":
            first = self.name()
            if self.is_("op", "("):
                raise SqlError(Kind.UNSUPPORTED, f"there is no function `{first.value}`", first.span)
            if self.take("op", "."):
                second = self.name()
                return A.ColumnRef(first, second, first.span.join(second.span))
            return A.ColumnRef(None, first, first.span)
        raise self.error(f"an expression is expected, not {t}")
