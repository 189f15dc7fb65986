"""Statements in, results out: the facade over parser, binder, DataFrames and the store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessel.errors import EngineError, Kind, LimitExceeded, SequenceError, Span, SqlError, TransactionAborted, TransactionStateError
from tessel.operators.sequences import DUPLICATE, NEW, verdict
from tessel.plans import bound as B
from tessel.plans.binder import bind, check_parameters
from tessel.plans.explain import explain
from tessel.plans.lower import Lowering, slot_name
from tessel.plans.parser import parse_statement
from tessel.sources.catalog import Catalog
from tessel.sources.store import Store
from tessel.sources.transaction import Transaction
from tessel.types import Value, check_size, type_of

MAX_SQL_BYTES, MAX_PARAMETERS, MAX_ROWS = 1 << 20, 65_536, 16_384


@dataclass(frozen=True)
class Result:
    """df for queries and EXPLAIN; affected rows and the commit index for changes."""

    df: DataFrame | None = None
    affected: int = 0
    index: int | None = None
    duplicate: bool = False

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self, cap: int | None = MAX_ROWS) -> list[tuple]:
        """All rows on the driver; more than cap is an error, never cut short."""
        if self.df is None:
            return []
        got = (self.df if cap is None else self.df.limit(cap + 1)).collect()
        if cap is not None and len(got) > cap:
            raise LimitExceeded(f"the result has more than {cap} rows")
        return [tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in got]


def fingerprint(domain: str, text: str, parameters: Sequence[Value] = ()) -> str:
    """Tells whether a repeated request is the same one."""
    typed = [[t.value if (t := type_of(p)) else None, p.hex() if isinstance(p, (bytes, bytearray)) else p] for p in parameters]
    return hashlib.sha256(json.dumps([domain, text, typed]).encode()).hexdigest()


def query_frame(sql: str, catalog: Catalog, scan, parameters: Sequence[Value] = ()) -> DataFrame:
    """A query's DataFrame over tables that scan gives: the dialect without a store."""
    made = bind(parse_statement(sql), catalog)
    if not isinstance(made.statement, B.Query):
        raise SqlError(Kind.UNSUPPORTED, "only a query can be made a DataFrame", Span(0, len(sql.encode())))
    check_parameters(made.parameters, parameters)
    return Lowering(scan, parameters).query(made.statement)


class Session:
    """One client's connection. Statements outside BEGIN commit by themselves.

    client and sequence number make a change idempotent: its repeat is answered from the record.
    Queries and EXPLAIN neither check nor use a number.
    """

    def __init__(self, store: Store, client: str | None = None) -> None:
        self.store, self.client = store, client
        self.txn: Transaction | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, client: str | None = None) -> Session:
        return cls(Store(spark, root), client)

    def execute(self, sql: str, parameters: Sequence[Value] = (), sequence: int | None = None) -> Result:
        if len(sql.encode("utf-8", "surrogatepass")) > MAX_SQL_BYTES or len(parameters) > MAX_PARAMETERS:
            raise LimitExceeded("the statement or its parameters are too long")
        for p in parameters:
            check_size(p)
        parsed = parse_statement(sql)
        catalog = self.txn.catalog if self.txn else self.store.state.catalog
        made = bind(parsed, catalog)
        if isinstance(made.statement, B.Control):
            if parameters:
                raise SqlError(Kind.UNSUPPORTED, f"{made.statement.action} takes no parameters", parsed.span)
            return self._control(made.statement.action, sequence)
        check_parameters(made.parameters, parameters)
        if self.txn is not None:
            point = self.txn.savepoint()
            try:
                return self._run(made.statement, self.txn, parameters)
            except Exception:
                self.txn.back_to(point)
                raise
        if isinstance(made.statement, (B.Query, B.Explain)):
            return self._run(made.statement, None, parameters)
        request = fingerprint("statement", sql, parameters)
        if (known := self._admit(sequence, request)) is not None:
            return known
        txn = self.store.begin()
        try:
            affected = self._run(made.statement, txn, parameters).affected
        except Exception:
            txn.end()
            raise
        if txn.read_only:  # nothing matched: no commit, and the number is not used
            txn.end()
            return Result(affected=0)
        outcome = txn.commit(self.client if sequence is not None else None, sequence, request, {"affected": affected})
        return Result(affected=affected, index=outcome.index)

    def _admit(self, sequence: int | None, request: str) -> Result | None:
        """None for a new request, the recorded result for a repeated one."""
        if sequence is None:
            return None
        if self.client is None:
            raise SequenceError("no_client", "a sequence number needs a client")
        record = self.store.state.clients.get(self.client)
        said = verdict(record and record.sequence, record and record.request_hash, sequence, request)
        if said == NEW:
            return None
        if said == DUPLICATE and record is not None:
            if "aborted" in record.result:
                raise TransactionAborted(record.result["aborted"])
            return Result(affected=record.result.get("affected", 0), duplicate=True)
        raise SequenceError(said, f"request {sequence} of client `{self.client}` is refused: {said}")

    def _control(self, action: str, sequence: int | None) -> Result:
        if action == "BEGIN":
            if self.txn is not None:
                raise TransactionStateError("a transaction is open already")
            self.txn = self.store.begin()
            return Result()
        if action == "COMMIT" and self.txn is None and sequence is not None:
            # the answer to a COMMIT may have been lost after it took place
            record = self.store.state.clients.get(self.client or "")
            if record and record.sequence == sequence and record.result.get("commit"):
                if "aborted" in record.result:
                    raise TransactionAborted(record.result["aborted"])
                return Result(affected=record.result.get("affected", 0), duplicate=True)
        if self.txn is None:
            raise TransactionStateError("no transaction is open")
        txn, self.txn = self.txn, None
        if action == "ROLLBACK":
            txn.rollback()
            return Result()
        request = fingerprint("commit", txn.id)
        try:
            if not txn.read_only and self._admit(sequence, request) is not None:
                raise EngineError("a transaction's id was used before")
        except EngineError:
            txn.end()
            raise
        outcome = txn.commit(self.client if sequence is not None else None, sequence, request, {"commit": True} if sequence is not None else {})
        return Result(affected=outcome.result.get("affected", 0), index=None if txn.read_only else outcome.index)

    def _run(self, s: B.Statement, txn: Transaction | None, parameters: Sequence[Value]) -> Result:
        match s:
            case B.Query():
                read_ts = self.store.state.index
                scan = txn.scan if txn else lambda t: self.store.snapshot(t, read_ts)
                return Result(Lowering(scan, parameters).query(s))
            case B.Explain():
                catalog = self.store.state.catalog  # indexes that are not committed are no access paths
                return Result(self.store.spark.createDataFrame([(explain(s.statement, catalog),)], "plan string"))
        assert txn is not None
        match s:
            case B.CreateTable():
                txn.create_table(s.name, s.schema)
                return Result()
            case B.CreateIndex():
                txn.create_index(s.name, s.table.name, s.table.schema.columns[s.column].name)
                return Result()
            case B.Insert():
                return Result(affected=txn.insert(s.table.name, [[self._constant(v, parameters) for v in s.values]]))
            case B.Update():
                columns = s.table.schema.columns
                assign = lambda df: {columns[i].name: self._over(s.table, e, parameters) for i, e in s.assignments}
                return Result(affected=txn.update(s.table.name, assign, self._where(s, parameters)))
            case B.Delete():
                return Result(affected=txn.delete(s.table.name, self._where(s, parameters)))
        raise AssertionError(s)

    def _where(self, s: B.Update | B.Delete, parameters: Sequence[Value]):
        return None if s.where is None else lambda df: self._over(s.table, s.where, parameters)

    @staticmethod
    def _over(table: B.Table, e: B.Expr, parameters: Sequence[Value]):
        """An expression over a table's own column names."""
        from pyspark.sql import functions as F

        lowering = Lowering(lambda t: None, parameters)  # type: ignore[arg-type,return-value]
        lowering.known |= {x: F.col(f"`{x.name}`") for x in B.walk(e) if isinstance(x, B.Slot)}
        return lowering.column(e)

    def _constant(self, e: B.Expr, parameters: Sequence[Value]) -> Value:
        """Literals and parameters are taken as they are; what is computed of them, Spark computes."""
        if isinstance(e, B.Literal):
            return e.value
        if isinstance(e, B.Parameter):
            return parameters[e.index]
        if any(isinstance(x, B.Slot) for x in B.walk(e)):
            raise SqlError(Kind.BIND, "a value of INSERT cannot name a column", e.span)
        row = self.store.spark.range(1).select(Lowering(lambda t: None, parameters).column(e)).first()  # type: ignore[arg-type,return-value]
        return row[0]


__all__ = ["Result", "Session", "fingerprint", "query_frame", "slot_name"]
