"""Queries whose rows are outcomes: which statements, requests and transactions are taken, and what is
said of the others. Each runs on a store that holds the customer table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.errors import EngineError, SqlError
from tessel.operators import checkers
from tessel.plans.binder import bind
from tessel.plans.explain import explain
from tessel.plans.parser import parse_statement
from tessel.queries import _frame, _store, catalog
from tessel.sources.store import Attempt, Store


def _values(rows: Iterable[tuple[str, str]]) -> str:
    """The SQL of (item, outcome) rows."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows) + ") t(item, outcome)"


def _said(act: Callable[[], object]) -> str:
    try:
        act()
    except SqlError as e:
        return e.kind.value
    except EngineError as e:
        return getattr(e, "verdict", None) or ("schema" if type(e).__name__ == "SchemaChanged" else e.code)
    return "ok"


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "item string, outcome string")


#: Statements in turn, and what becomes of them.
STATEMENTS = (
    ("CREATE TABLE berth (id INT64 PRIMARY KEY, label TEXT NOT NULL)", "ok"), ("CREATE TABLE BERTH (id INT64 PRIMARY KEY)", "bind"), ("CREATE TABLE pier (id INT64)", "constraint"),
    ("CREATE INDEX customer_segment ON customer(segment)", "ok"), ("CREATE INDEX customer_segment ON customer(rich)", "bind"), ("CREATE INDEX odd ON customer(nothing)", "bind"),
    ("INSERT INTO berth VALUES (1, 'a')", "ok"), ("INSERT INTO berth VALUES (1, 'b')", "constraint"), ("INSERT INTO berth VALUES (2, NULL)", "constraint"),
    ("BEGIN", "ok"), ("BEGIN", "invalid_request"), ("INSERT INTO berth VALUES (3, 'c')", "ok"), ("INSERT INTO berth VALUES (3, 'again')", "constraint"),
    ("CREATE INDEX berth_label ON berth(label)", "ok"), ("ROLLBACK", "ok"), ("CREATE INDEX berth_label ON berth(label)", "ok"), ("COMMIT", "invalid_request"), ("UPDATE berth SET label = 'z' WHERE id = 77", "ok"),
)


@_frame("statement_outcomes", _values((f"{i:02d} {sql}", said) for i, (sql, said) in enumerate(STATEMENTS)))
def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _store(spark, sf_dir)
    return _rows(spark, [(f"{i:02d} {sql}", _said(lambda sql=sql: session.execute(sql))) for i, (sql, _) in enumerate(STATEMENTS)])


#: What the binder says before anything runs.
REJECTIONS = (
    ("SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY rich", "type"), ("SELECT c_name FROM customer GROUP BY c_mktsegment", "type"), ("SELECT COUNT(*) FROM customer ORDER BY c_name", "type"),
    ("SELECT c_custkey FROM customer WHERE COUNT(*) = 1", "type"), ("SELECT c_custkey FROM customer GROUP BY SUM(cents)", "type"), ("SELECT SUM(MAX(cents)) FROM customer", "type"),
    ("UPDATE customer SET cents = COUNT(*)", "type"), ("SELECT SUM(c_name) FROM customer", "type"), ("SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment", "ok"),
    ("SELECT COUNT(*) + 1 FROM customer", "lex"), ("SELECT LOWER(c_name) FROM customer", "unsupported"), ("SELECT c_name FROM", "parse"),
)


@_frame("binder_verdicts", _values(REJECTIONS))
def _binder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(sql, _said(lambda sql=sql: bind(parse_statement(sql), catalog()))) for sql, _ in REJECTIONS])


PLANS = (
    ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY cents LIMIT 5", "Project/  Limit/    Sort/      Filter/        IndexScan table=orders index=orders_by_customer/"),
    ("SELECT o_orderkey FROM orders WHERE cents = 7", "Project/  Filter/    SeqScan table=orders/"),
    ("DELETE FROM nation", "Delete table=nation/"),
)


@_frame("explain_plans", _values(PLANS))
def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(sql, explain(bind(parse_statement(sql), catalog()).statement, catalog()).replace("\n", "/")) for sql, _ in PLANS])


ANOMALIES = (("first committer", "ok"), ("second on one row", "conflict"), ("skewed writes, first", "ok"), ("skewed writes, second", "ok"), ("writer before a schema change", "schema"), ("read beyond the last commit", "snapshot_unavailable"))


@_frame("transaction_anomalies", _values(ANOMALIES))
def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two writers of a row one fails; writers of different rows that read each other's don't; a
    change of the catalog fails older writers."""
    store = _store(spark, sf_dir).store

    def writer(key: int):
        txn = store.begin()
        txn.update("customer", lambda d: {"cents": F.lit(0).cast("long")}, lambda d: d["c_custkey"] == key)
        return txn

    a, b = writer(1), writer(1)
    said = [_said(a.commit), _said(b.commit)]
    a, b = writer(2), writer(3)
    said += [_said(a.commit), _said(b.commit)]
    late, ddl = writer(4), store.begin()
    ddl.create_index("by_name", "customer", "c_name")
    ddl.commit()
    said += [_said(late.commit), _said(lambda: store.table("customer", 99))]
    return _rows(spark, [(item, x) for (item, _), x in zip(ANOMALIES, said, strict=True)])


#: Client, sequence number, request, index; outcome by the state of the log before.
REQUESTS = (
    ("a", 1, "h1", 2, "committed"), ("a", 1, "h1", 2, "committed"), ("a", 1, "h1", 3, "duplicate"), ("a", 1, "other", 4, "hash_mismatch"), ("a", 3, "h3", 5, "gap"),
    ("b", 2, "h1", 6, "first_not_one"), ("a", 2, "h2", 7, "committed"), ("a", 1, "h1", 8, "too_old"), ("", 0, "nothing", 9, "no_op"), ("b", 1, "x1", 12, "conflict"),
)


@_frame("apply_outcomes", _values((f"{n:02d} {i}", said) for n, (_, _, _, i, said) in enumerate(REQUESTS)) + " UNION ALL SELECT 'rows', CAST(count(*) + 2 AS VARCHAR) FROM v_customer UNION ALL SELECT 'counts', '3 1 1 4'", "customer")
def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of clients, applied at given indexes: an applied index gives its recorded outcome, a
    repeat and a refused request use up theirs, an index out of turn is an error."""
    store, out = _store(spark, sf_dir).store, []
    for n, (client, sequence, request, index, _) in enumerate(REQUESTS):
        attempt: Attempt | None = None
        if client:
            txn = store.begin()
            txn.insert("customer", [(-10 - n, "new", None, None, None, None, None)])
            attempt = txn.attempt()
            attempt.client, attempt.sequence = client, sequence
        before = dict(store.state.counts)
        try:
            got = store.apply(index, request, attempt)
            changed = [k for k, v in store.state.counts.items() if v != before[k]]
            said = got.result.get("rejected") or (changed[0] if changed else "committed" if got.committed else "no_op")
        except EngineError as e:
            said = e.code
        out.append((f"{n:02d} {index}", said))
    again = Store(spark, store.folder.root)
    counts = again.stats()
    out.append(("rows", str(again.table("customer").count())))
    out.append(("counts", " ".join(str(counts[k]) for k in ("committed", "no_op", "duplicate", "rejected"))))
    return _rows(spark, out)


@_frame("store_stats_and_status", """SELECT 'committed' AS item, 3 AS n UNION ALL SELECT 'aborted', 1 UNION ALL SELECT 'versions', count(*) + count(*) FILTER (rich) + 1 FROM v_customer UNION ALL
SELECT 'tombstones', count(*) FILTER (rich) FROM v_customer UNION ALL SELECT 'applied_index', 4 UNION ALL SELECT 'vacuum_floor', 0 UNION ALL SELECT 'active_transactions', 0 UNION ALL SELECT 'tables', 1""", "customer")
def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _store(spark, sf_dir)
    store = session.store
    lost = store.begin()
    lost.update("customer", lambda d: {"cents": F.lit(0).cast("long")}, lambda d: d["rich"])
    session.execute("DELETE FROM customer WHERE rich")
    store.apply(3, "lost", lost.attempt())
    lost.end()
    session.execute("INSERT INTO customer (c_custkey) VALUES (-9)")
    found = store.stats() | store.status()
    names = ("committed", "aborted", "versions", "tombstones", "applied_index", "vacuum_floor", "active_transactions", "tables")
    return spark.createDataFrame([(n, found[n]) for n in names], "item string, n long")


@_frame("store_export_restore", "SELECT 1 AS at, c_custkey, c_name, cents FROM v_customer UNION ALL SELECT 2, c_custkey, c_name, cents FROM v_customer WHERE NOT coalesce(cents < 0, FALSE)", "customer")
def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored export reads like its source at each commit."""
    session = _store(spark, sf_dir)
    session.execute("DELETE FROM customer WHERE cents < 0")
    root = f"{session.store.folder.root}-{uuid.uuid4().hex}"
    session.store.export(f"{root}-out")
    store = Store.restore(spark, f"{root}-out", f"{root}-new")
    at = [store.table("customer", i).select(F.lit(i).alias("at"), "c_custkey", "c_name", "cents") for i in (1, 2)]
    return at[0].union(at[1])


@_frame("linearizable_registers", "SELECT user_id AS history, 4 AS operations, user_id % 3 <> 2 AS linearizable FROM (SELECT DISTINCT user_id FROM events)")
def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of each user: a write, a read that overlaps a second write and sees either, and a
    last read that in every third history sees the value that was overwritten."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("history")).distinct()
    stale = F.col("history") % 3 == 2
    op = lambda name, value, seen, start, end: F.struct(F.lit(name).alias("op"), F.lit("x").alias("key"), value.alias("input"), F.lit(None).cast("string").alias("expected"), seen.alias("output"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    none, one, two = F.lit(None).cast("string"), F.lit("1"), F.lit("2")
    each = F.array(op("put", one, none, 0, 1), op("put", two, none, 2, 5), op("get", none, F.when(F.col("history") % 3 == 0, one).otherwise(two), 3, 4), op("get", none, F.when(stale, one).otherwise(two), 6, 7))
    return checkers.linearizable_histories(users.select("history", F.explode(each).alias("o")).select("history", "o.*"))
