"""Queries over the driver's tables, each with the SQL that must give the same rows.

Most go through the dialect's own parser and binder, over typed views of the tables. NULLs are
made, as the tables have none; order is shown by a rank column.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import arithmetic, order_key
from tessel.operators import checkers, sequences
from tessel.operators import versioned as V
from tessel.plans.bound import Table
from tessel.plans.builder import OrderBy, Query
from tessel.session import Session, query_frame
from tessel.sources import pinned, table
from tessel.sources.catalog import Catalog
from tessel.sources.store import Store
from tessel.types import Column as C
from tessel.types import DataType as D
from tessel.types import Schema, Value

_KINDS = {"i": D.INT64, "t": D.TEXT, "b": D.BOOL, "x": D.BYTES}

#: Typed views: name, kind (upper case: the key) and the SQL expression of each column, the same in Spark and DuckDB.
VIEWS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "region": ("region", [("r_regionkey", "I", "CAST(r_regionkey AS BIGINT)"), ("r_name", "t", "r_name")]),
    "nation": ("nation", [("n_nationkey", "I", "CAST(n_nationkey AS BIGINT)"), ("n_name", "t", "n_name"), ("n_regionkey", "i", "CAST(n_regionkey AS BIGINT)")]),
    "customer": ("customer", [
        ("c_custkey", "I", "c_custkey"), ("c_name", "t", "c_name"), ("c_nationkey", "i", "CAST(c_nationkey AS BIGINT)"), ("c_mktsegment", "t", "c_mktsegment"),
        ("cents", "i", "CAST(ROUND(c_acctbal * 100) AS BIGINT)"), ("rich", "b", "c_acctbal > 5000"), ("segment", "t", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END"),
    ]),
    "orders": ("orders", [
        ("o_orderkey", "I", "o_orderkey"), ("o_custkey", "i", "o_custkey"), ("o_orderstatus", "t", "o_orderstatus"), ("o_orderpriority", "t", "o_orderpriority"),
        ("cents", "i", "CAST(ROUND(o_totalprice * 100) AS BIGINT)"), ("priority", "t", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END"),
        ("half", "i", "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END"), ("open", "b", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus = 'O' END"),
    ]),
    "part": ("part", [
        ("p_partkey", "I", "p_partkey"), ("p_name", "t", "p_name"), ("p_brand", "t", "p_brand"), ("p_type", "t", "p_type"), ("p_size", "i", "CAST(p_size AS BIGINT)"),
        ("maybe_size", "i", "CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) END"),
    ]),
    "events": ("events", [
        ("event_id", "I", "event_id"), ("user_id", "i", "user_id"), ("event_type", "t", "event_type"),
        ("amount", "i", "CASE WHEN event_type <> 'error' THEN event_id % 100 END"), ("who", "i", "CASE WHEN event_id % 10 <> 0 THEN user_id END"), ("sale", "b", "event_type = 'purchase'"),
    ]),
}


def catalog() -> Catalog:
    out = Catalog()
    for name, (_, columns) in VIEWS.items():
        out.create_table(name, Schema(tuple(C(c, _KINDS[k.lower()], not k.isupper(), k.isupper()) for c, k, _ in columns)))
    out.create_index("orders_by_customer", out.tables["orders"].id, 1)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).select(*(F.expr(e).alias(c) for c, _, e in columns))


def _with(*names: str) -> str:
    """The views as common table expressions of the same name and a v before it."""
    return "WITH " + ", ".join(f"v_{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, _, e in VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names) + "\n"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that executors share, as far as one is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessel-")


def ranked(df: DataFrame, name: str) -> DataFrame:
    """df, which is sorted as a whole, with each row's place from 1. The sort is by ranges and no task
    sees all rows: the sorted parts are written once, and a part's rows are placed after those of the parts before it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/sorted-{uuid.uuid4().hex}"
    placed = df.withColumn("_at", F.monotonically_increasing_id())  # the part, and the place in it in the lower 33 bits
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for part, n in rows.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((part, before))
        before += n
    parts = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return rows.join(parts, "_part").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))


def _dialect(name: str, sql: str, oracle: str, views: str, parameters: tuple[Value, ...] = (), rank: bool = False, whole: bool = False) -> None:
    """Registers a query of the dialect. oracle: DuckDB SQL over v_<view>. whole: a sorted result without a limit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query_frame(sql, catalog(), lambda t: view(pinned(spark), sf_dir, t.name), parameters)
        if whole:
            return ranked(df, "rnk")
        # a limited and sorted result is one partition, whose rows are counted in order
        return df.withColumn("rnk", F.monotonically_increasing_id() + 1) if rank else df

    QUERIES[name] = run
    ORACLE_SQL[name] = _with(*views.split()) + oracle


def _frame(name: str, oracle: str, views: str = "") -> Callable:
    """Registers a function of (spark, sf_dir)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(pinned(spark), sf_dir)
        ORACLE_SQL[name] = (_with(*views.split()) if views else "") + oracle
        return f

    return add


FLAGSHIP = """SELECT c_mktsegment, COUNT(*) AS row_count, SUM(o_custkey) AS total FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY total DESC LIMIT 3"""
_dialect("flagship", FLAGSHIP, """SELECT c_mktsegment, count(*) AS row_count, CAST(sum(o_custkey) AS BIGINT) AS total FROM v_customer JOIN v_orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY total DESC, c_mktsegment LIMIT 3""", "customer orders")

# scans, projection, names
_dialect("scan_project", "SELECT n_name, n_nationkey FROM nation", "SELECT n_name, n_nationkey FROM v_nation", "nation")
_dialect("project_wildcard_join", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT v_nation.*, v_region.* FROM v_nation JOIN v_region ON n_regionkey = r_regionkey", "nation region")
_dialect("expr_names", "SELECT p_size < 10, -p_size, p_partkey, p_name AS label FROM part", "SELECT p_size < 10 AS expr1, -p_size AS expr2, p_partkey, p_name AS label FROM v_part", "part")

# predicates
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _dialect(f"filter_{_name}", f"SELECT o_orderkey, half FROM orders WHERE half {_op} 77", f"SELECT o_orderkey, half FROM v_orders WHERE half {_op} 77", "orders")
_dialect("filter_literal_left", "SELECT o_orderkey FROM orders WHERE 20000000 <= cents", "SELECT o_orderkey FROM v_orders WHERE 20000000 <= cents", "orders")
_dialect("filter_three_valued", "SELECT o_orderkey FROM orders WHERE open OR NOT (priority = '1-URGENT' AND half > 50)", "SELECT o_orderkey FROM v_orders WHERE open OR NOT (priority = '1-URGENT' AND half > 50)", "orders")
_dialect("truth_values", "SELECT open, priority = '1-URGENT' AS urgent, open AND priority = '1-URGENT' AS both, open OR priority = '1-URGENT' AS one, NOT open AS shut, COUNT(*) AS n FROM orders GROUP BY open, priority = '1-URGENT', open AND priority = '1-URGENT', open OR priority = '1-URGENT', NOT open",
         "SELECT open, priority = '1-URGENT' AS urgent, open AND priority = '1-URGENT' AS both, open OR priority = '1-URGENT' AS one, NOT open AS shut, count(*) AS n FROM v_orders GROUP BY ALL", "orders")
_dialect("is_null", "SELECT priority IS NULL AS missing, half IS NOT NULL AS there, COUNT(*) AS n FROM orders GROUP BY priority IS NULL, half IS NOT NULL", "SELECT priority IS NULL AS missing, half IS NOT NULL AS there, count(*) AS n FROM v_orders GROUP BY ALL", "orders")
_dialect("not_precedence", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND half IS NOT NULL OR o_orderkey < 10", "SELECT o_orderkey FROM v_orders WHERE ((NOT (o_orderstatus = 'F')) AND half IS NOT NULL) OR o_orderkey < 10", "orders")
_dialect("negate", "SELECT p_partkey, -maybe_size AS minus, - - p_size AS same FROM part", "SELECT p_partkey, -maybe_size AS minus, p_size AS same FROM v_part", "part")
_dialect("param_binding", "SELECT o_orderkey, cents FROM orders WHERE o_orderstatus = ? AND ? < cents AND open = ?", "SELECT o_orderkey, cents FROM v_orders WHERE o_orderstatus = 'O' AND 15000000 < cents AND open = TRUE", "orders", ("O", 15_000_000, True))
_dialect("index_eq_probe", "SELECT o_orderkey, cents FROM orders WHERE o_custkey = 42", "SELECT o_orderkey, cents FROM v_orders WHERE o_custkey = 42", "orders")
_dialect("point_get", "SELECT * FROM orders WHERE o_orderkey = ?", "SELECT * FROM v_orders WHERE o_orderkey = 1000", "orders", (1000,))
_dialect("text_literals", "SELECT COUNT(*) AS n, 'it''s' AS quote, 'a\\n' AS plain FROM region", "SELECT count(*) AS n, 'it''s' AS quote, 'a\\n' AS plain FROM v_region", "region")

# joins
_dialect("join_multiway", "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name", "SELECT r_name, count(*) AS n FROM v_region JOIN v_nation ON r_regionkey = n_regionkey JOIN v_customer ON c_nationkey = n_nationkey GROUP BY r_name", "region nation customer")
_dialect("join_nested_loop", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", "SELECT n_name, r_name FROM v_nation JOIN v_region ON n_regionkey < r_regionkey", "nation region")
_dialect("join_conjunctive_on", "SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND cents > 900000", "SELECT n_name, c_name FROM v_customer JOIN v_nation ON c_nationkey = n_nationkey AND cents > 900000", "customer nation")
_dialect("join_null_keys", "SELECT c_name, COUNT(*) AS n FROM orders JOIN customer ON half = c_custkey GROUP BY c_name", "SELECT c_name, count(*) AS n FROM v_orders JOIN v_customer ON half = c_custkey GROUP BY c_name", "orders customer")
_dialect("join_self", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name, b.n_name AS other FROM v_nation a JOIN v_nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "nation")

# aggregates
_dialect("agg_null_semantics", "SELECT event_type, COUNT(*) AS all_rows, COUNT(amount) AS known, SUM(amount) AS total, MIN(amount) AS low, MAX(amount) AS high FROM events GROUP BY event_type", "SELECT event_type, count(*) AS all_rows, count(amount) AS known, CAST(sum(amount) AS BIGINT) AS total, min(amount) AS low, max(amount) AS high FROM v_events GROUP BY event_type", "events")
_dialect("agg_in_expression", "SELECT event_type, COUNT(*) > 1000 AS many, -SUM(amount) AS minus FROM events GROUP BY event_type ORDER BY COUNT(*)", "SELECT event_type, count(*) > 1000 AS many, CAST(-sum(amount) AS BIGINT) AS minus FROM v_events GROUP BY event_type", "events")
_dialect("minmax_text_bool", "SELECT event_type, MIN(sale) AS low, MAX(sale) AS high, MIN(event_type) AS first, MAX(user_id) AS top FROM events GROUP BY event_type", "SELECT event_type, bool_and(sale) AS low, bool_or(sale) AS high, min(event_type) AS first, max(user_id) AS top FROM v_events GROUP BY event_type", "events")
_dialect("agg_global", "SELECT COUNT(*) AS n, SUM(cents) AS total, MIN(priority) AS first FROM orders", "SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(priority) AS first FROM v_orders", "orders")
_dialect("agg_global_empty", "SELECT COUNT(*) AS n, SUM(cents) AS total, MAX(priority) AS last FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, max(priority) AS last FROM v_orders WHERE o_orderkey < 0", "orders")
_dialect("agg_null_group_key", "SELECT who, COUNT(*) AS n FROM events GROUP BY who", "SELECT who, count(*) AS n FROM v_events GROUP BY who", "events")
_dialect("agg_group_by_expr", "SELECT p_size > 25 AS large, COUNT(*) AS n, SUM(p_size) AS total FROM part GROUP BY p_size > 25", "SELECT p_size > 25 AS large, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM v_part GROUP BY 1", "part")
_dialect("group_distinct", "SELECT p_brand, maybe_size FROM part GROUP BY p_brand, maybe_size", "SELECT DISTINCT p_brand, maybe_size FROM v_part", "part")
_dialect("group_constant_empty", "SELECT 1 AS one FROM region WHERE FALSE GROUP BY 1", "SELECT CAST(1 AS BIGINT) AS one FROM v_region WHERE FALSE", "region")

# order and limit
# the same orders over all rows
for _name, _sql in (("sort_all_asc_nulls_last", "half ASC NULLS LAST"), ("sort_all_desc_nulls_first", "half DESC NULLS FIRST")):
    _dialect(_name, f"SELECT o_orderkey, half FROM orders ORDER BY half {_sql.split()[1]}, o_orderkey", f"SELECT o_orderkey, half, row_number() OVER (ORDER BY {_sql}, o_orderkey) AS rnk FROM v_orders", "orders", whole=True)
_dialect("sort_all_alias_and_unprojected", "SELECT o_orderkey AS cents FROM orders ORDER BY o_orderpriority, cents DESC", "SELECT o_orderkey AS cents, row_number() OVER (ORDER BY o_orderpriority, o_orderkey DESC) AS rnk FROM v_orders", "orders", whole=True)
_dialect("topk", "SELECT o_orderkey, cents FROM orders ORDER BY cents DESC LIMIT ?", "SELECT o_orderkey, cents, row_number() OVER (ORDER BY cents DESC, o_orderkey) AS rnk FROM v_orders ORDER BY rnk LIMIT 25", "orders", (25,), rank=True)
_dialect("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM v_orders LIMIT 0", "orders")
_dialect("limit_implicit_pk_order", "SELECT o_orderkey, o_orderstatus FROM orders LIMIT 10", "SELECT o_orderkey, o_orderstatus FROM v_orders ORDER BY o_orderkey LIMIT 10", "orders")
_dialect("order_by_constant", "SELECT n_name FROM nation ORDER BY 2 LIMIT 3", "SELECT n_name FROM v_nation ORDER BY n_nationkey LIMIT 3", "nation")


@_frame("offset_builder", "SELECT o_orderkey, row_number() OVER (ORDER BY priority DESC NULLS LAST, o_orderkey) - 20 AS rnk FROM v_orders QUALIFY rnk BETWEEN 1 AND 30", "orders")
def _offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(None, [("o_orderkey", F.col("o_orderkey"))], [OrderBy("priority", True, False)], 20, 30)
    return q.on(view(spark, sf_dir, "orders"), "o_orderkey").withColumn("rnk", F.monotonically_increasing_id() + 1)


@_frame("builder_filter_sort", "SELECT o_orderkey, half, row_number() OVER (ORDER BY half NULLS FIRST, o_orderkey) AS rnk FROM v_orders WHERE open ORDER BY rnk LIMIT 40", "orders")
def _builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(F.col("open"), [(c, F.col(c)) for c in ("o_orderkey", "half")], [OrderBy("half", False, True)], 0, 40)
    return q.on(view(spark, sf_dir, "orders"), "o_orderkey").withColumn("rnk", F.monotonically_increasing_id() + 1)


@_frame("engine_arithmetic", "SELECT p_partkey, p_size + 3 AS plus, p_size - 30 AS minus, p_size * -7 AS times, -p_size // 7 + CASE WHEN p_size % 7 <> 0 AND -p_size // 7 * 7 <> -p_size AND -p_size // 7 < -(p_size // 7) THEN 1 ELSE 0 END AS quotient, maybe_size + 1 AS maybe FROM v_part", "part")
def _arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, n = F.col("p_size"), lambda v: F.lit(v).cast("bigint")
    return view(spark, sf_dir, "part").select(
        "p_partkey", arithmetic("+", size, n(3)).alias("plus"), arithmetic("-", size, n(30)).alias("minus"), arithmetic("*", size, n(-7)).alias("times"),
        arithmetic("/", -size, n(7)).alias("quotient"), arithmetic("+", F.col("maybe_size"), n(1)).alias("maybe"),
    )


# versions: events are a log of users, an error is a tombstone
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias(V.COMMIT), (F.col("event_type") == "error").alias(V.DELETED))


def _share(numerator: int) -> str:
    return f"(SELECT max(event_id) * {numerator} // 10 FROM events)"


def _cut(spark: SparkSession, sf_dir: str, numerator: int) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] * numerator // 10


@_frame("mvcc_snapshot_read", f"SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= {_share(6)} GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.snapshot(_log(spark, sf_dir), ["user_id"], _cut(spark, sf_dir, 6))


@_frame("mvcc_snapshot_over_base", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _over_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, cut = _log(spark, sf_dir), _cut(spark, sf_dir, 8)
    return V.snapshot_over_base(V.latest(log, ["user_id"], cut), log.filter(F.col(V.COMMIT) > cut), ["user_id"])


_WRITES = "c_custkey % 10 IN (0, 1)"


@_frame("mvcc_overlay_read", f"SELECT c_custkey, c_name, cents FROM v_customer WHERE NOT ({_WRITES}) UNION ALL SELECT c_custkey, 'own', -cents FROM v_customer WHERE c_custkey % 10 = 1", "customer")
def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer").select("c_custkey", "c_name", "cents")
    own = rows.filter(_WRITES).select("c_custkey", F.lit("own").alias("c_name"), (-F.col("cents")).alias("cents"), (F.col("c_custkey") % 10 == 0).alias(V.DELETED))
    return V.overlay(rows, own, ["c_custkey"])


@_frame("mvcc_conflicts", f"SELECT user_id, max(event_id) AS _commit_index FROM events WHERE event_id > {_share(9)} AND user_id % 3 = 0 GROUP BY user_id")
def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return V.conflicts(log.filter("user_id % 3 = 0"), log, ["user_id"], _cut(spark, sf_dir, 9))


@_frame("mvcc_vacuum", f"""SELECT user_id, event_type, event_id AS _commit_index, event_type = 'error' AS _deleted FROM events WHERE event_id > {_share(5)}
UNION ALL SELECT user_id, max_by(event_type, event_id), max(event_id), FALSE FROM events WHERE event_id <= {_share(5)} GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'""")
def _vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vacuum(_log(spark, sf_dir), ["user_id"], _cut(spark, sf_dir, 5))


@_frame("engine_stats", "SELECT count(*) AS versions, count(*) FILTER (event_type = 'error') AS tombstones, count(DISTINCT user_id) AS keys FROM events")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).agg(F.count("*").alias("versions"), F.count(F.when(F.col(V.DELETED), 1)).alias("tombstones"), F.count_distinct("user_id").alias("keys"))


@_frame("snapshot_export_validation", "SELECT l_orderkey, l_linenumber, count(*) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return V.key_errors(rows, ["l_orderkey"], "l_linenumber")


# client sequences: turns shifted to start at 1, some left out, some repeated with other content
_REQUESTS = """SELECT conv_id AS client, turn + 1 AS seq, md5(text) AS request_hash, turn * 4 AS arrival FROM conversations WHERE NOT (conv_id % 5 = 1 AND turn = 2) AND NOT (conv_id % 5 = 4 AND turn = 0)
UNION ALL SELECT conv_id, turn + 1, md5(text), turn * 4 + 1 FROM conversations WHERE conv_id % 5 = 2
UNION ALL SELECT conv_id, turn + 1, md5(text || '!'), turn * 4 + 2 FROM conversations WHERE conv_id % 5 = 3 AND turn % 2 = 1
UNION ALL SELECT conv_id, 1, md5('late'), turn * 4 + 3 FROM conversations WHERE conv_id % 5 = 0 AND turn = 3"""


@_frame("seq_admission", f"""WITH RECURSIVE r AS ({_REQUESTS}), o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY arrival) AS i FROM r),
f AS (SELECT client, 0 AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS request_hash, CAST(0 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS BIGINT) AS last_admitted, '' AS verdict FROM o WHERE i = 1
UNION ALL SELECT o.client, o.i, o.seq, o.request_hash, CASE WHEN o.seq = f.last + 1 THEN o.seq ELSE f.last END, CASE WHEN o.seq = f.last + 1 THEN o.request_hash ELSE f.h END, nullif(f.last, 0),
CASE WHEN f.last = 0 AND o.seq <> 1 THEN 'first_not_one' WHEN o.seq = f.last + 1 THEN 'new' WHEN o.seq = f.last THEN CASE WHEN o.request_hash = f.h THEN 'duplicate' ELSE 'hash_mismatch' END WHEN o.seq > f.last THEN 'gap' ELSE 'too_old' END
FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)
SELECT client, seq, request_hash, last_admitted, verdict FROM f WHERE i > 0""")
def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    part = lambda where, seq, text, at: c.filter(where).select(F.col("conv_id").alias("client"), seq.cast("long").alias("seq"), F.md5(text).alias("request_hash"), (F.col("turn") * 4 + at).alias("arrival"))
    own = F.col("turn") + 1
    log = part("NOT (conv_id % 5 = 1 AND turn = 2) AND NOT (conv_id % 5 = 4 AND turn = 0)", own, F.col("text"), 0)
    log = log.union(part("conv_id % 5 = 2", own, F.col("text"), 1)).union(part("conv_id % 5 = 3 AND turn % 2 = 1", own, F.concat("text", F.lit("!")), 2)).union(part("conv_id % 5 = 0 AND turn = 3", F.lit(1), F.lit("late"), 3))
    return sequences.classify(log, "client", "seq", "request_hash", ["arrival"]).drop("arrival")


# history checkers
@_frame("si_expected_version", "SELECT e.event_id, e.user_id AS key, e.event_id - 5 AS read_ts, (SELECT max(v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'purchase' AND v.event_id <= e.event_id - 5) AS expected_version FROM events e WHERE e.event_type = 'view'")
def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    reads = e.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("key"), (F.col("event_id") - 5).alias("read_ts"))
    versions = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_ts"))
    return checkers.expected_versions(reads, versions, "key", "read_ts", "commit_ts")


@_frame("si_fcw_violations", "SELECT w.event_id AS commit_ts, w.user_id AS key, w.event_id - 200 AS read_ts, max(o.event_id) AS previous_commit FROM events w JOIN events o ON o.user_id = w.user_id AND o.event_id < w.event_id AND o.event_id > w.event_id - 200 GROUP BY 1, 2, 3")
def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_ts"), F.col("user_id").alias("key"), (F.col("event_id") - 200).alias("read_ts"))
    return checkers.lost_updates(writes)


@_frame("percentile_nearest_rank", "SELECT o_orderstatus, count(*) AS count, min(cents) AS min, max(cents) AS max, CAST(sum(cents) AS DOUBLE) / count(*) AS mean, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.95) AS p95, quantile_disc(cents, 0.99) AS p99 FROM v_orders GROUP BY o_orderstatus", "orders")
def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkers.nearest_rank(view(spark, sf_dir, "orders"), "cents", [0.5, 0.95, 0.99], ["o_orderstatus"])


@_frame("sort_all_four_ways", """SELECT o_orderkey, row_number() OVER (ORDER BY half ASC NULLS FIRST, o_orderkey) AS a, row_number() OVER (ORDER BY half ASC NULLS LAST, o_orderkey) AS b,
row_number() OVER (ORDER BY half DESC NULLS FIRST, o_orderkey) AS c, row_number() OVER (ORDER BY half DESC NULLS LAST, o_orderkey) AS d FROM v_orders""", "orders")
def _all_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "orders").select("o_orderkey", "half")
    for name, descending, nulls_first in (("a", False, True), ("b", False, False), ("c", True, True), ("d", True, False)):
        df = ranked(df.orderBy(order_key(F.col("half"), descending, nulls_first), "o_orderkey"), name)
    return df.drop("half")


# changes through statements, on a store that a load has filled
def _store(spark: SparkSession, sf_dir: str, name: str = "customer") -> Session:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessel-")
    store = Store(spark, f"{base}/store-{uuid.uuid4().hex}")
    txn = store.begin()
    loaded: Table = txn.create_table(name, catalog().tables[name].schema)
    txn.load(loaded.name, view(spark, sf_dir, name))
    txn.commit()
    return Session(store, "client")


def _changes(name: str, oracle: str, *statements: tuple[str, tuple[Value, ...]]) -> None:
    @_frame(name, oracle, "customer")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _store(spark, sf_dir)
        for sql, parameters in statements:
            session.execute(sql, parameters)
        return session.store.table("customer")


_ALL = "c_custkey, c_name, c_nationkey, c_mktsegment, cents, rich, segment"
_changes("dml_insert", f"SELECT {_ALL} FROM v_customer UNION ALL SELECT -5, 'new', NULL, 'X', NULL, TRUE, NULL", ("INSERT INTO customer (c_name, c_custkey, c_mktsegment, rich) VALUES (?, -5, 'X', TRUE)", ("new",)))
_changes("dml_update", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN -cents ELSE cents END AS cents, rich, segment FROM v_customer", ("UPDATE customer SET cents = -cents WHERE c_mktsegment = 'BUILDING'", ()))
_changes("dml_delete", f"SELECT {_ALL} FROM v_customer WHERE NOT coalesce(segment = 'MACHINERY', FALSE)", ("DELETE FROM customer WHERE segment = ?", ("MACHINERY",)))
_changes("update_reads_original", "SELECT c_custkey, c_mktsegment AS c_name, c_nationkey, c_name AS c_mktsegment, cents, rich, segment FROM v_customer", ("UPDATE customer SET c_name = c_mktsegment, c_mktsegment = c_name", ()))
_changes("txn_commit_and_rollback", f"SELECT {_ALL} FROM v_customer WHERE c_custkey <> 2 AND c_custkey <> 3",
         ("BEGIN", ()), ("DELETE FROM customer WHERE c_custkey = 2", ()), ("INSERT INTO customer (c_custkey) VALUES (2)", ()), ("DELETE FROM customer WHERE c_custkey = 2 OR c_custkey = 3", ()), ("COMMIT", ()),
         ("BEGIN TRANSACTION", ()), ("DELETE FROM customer", ()), ("ROLLBACK", ()))


@_frame("dml_upsert", f"SELECT {_ALL} FROM v_customer WHERE c_custkey > 2 UNION ALL SELECT 1, 'one', NULL, NULL, 1, NULL, NULL UNION ALL SELECT 2, 'two', NULL, NULL, 2, NULL, NULL UNION ALL SELECT -7, 'seven', NULL, NULL, 7, NULL, NULL UNION ALL SELECT {_ALL} FROM v_customer WHERE c_custkey < 1", "customer")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _store(spark, sf_dir)
    txn = session.store.begin()
    txn.upsert("customer", [(k, n, None, None, abs(k), None, None) for k, n in ((1, "one"), (2, "two"), (-7, "seven"))])
    txn.commit()
    return session.store.table("customer")


@_frame("store_time_travel", f"SELECT 1 AS at, count(*) AS n FROM v_customer UNION ALL SELECT 2, count(*) FROM v_customer WHERE cents >= 0 UNION ALL SELECT 3, count(*) FROM v_customer WHERE cents >= 0 AND rich", "customer")
def _travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _store(spark, sf_dir)
    session.execute("DELETE FROM customer WHERE cents < 0")
    session.execute("DELETE FROM customer WHERE NOT rich")
    parts = [session.store.table("customer", at).agg(F.lit(at).alias("at"), F.count("*").alias("n")) for at in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])
