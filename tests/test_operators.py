import duckdb
import pytest
from pyspark.sql import functions as F

from tessel import outcomes  # noqa: F401  registers its queries
from tessel.errors import EngineError
from tessel.functions import arithmetic, negate
from tessel.operators import checkers, sequences
from tessel.queries import ORACLE_SQL, QUERIES
from tessel.types import Column, DataType, Schema

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(name, spark, con):
    df = QUERIES[name](spark, SF)
    got = sorted(str(sorted(r.asDict().items())) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert got == sorted(str(sorted(zip(names, r, strict=True))) for r in found.fetchall())


@pytest.mark.parametrize("name, nulls_at", [("sort_all_asc_nulls_last", 10_000), ("sort_all_desc_nulls_first", 0)])
def test_whole_tables_are_sorted_and_ranked(name, nulls_at, spark):
    """Nulls and values both get ranks; no cap hides either."""
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").orderBy("rnk").collect()
    assert [r.rnk for r in rows] == list(range(1, 15_001))
    assert [i for i, r in enumerate(rows) if r.half is None] == list(range(nulls_at, nulls_at + 5_000))
    values = [r.half for r in rows if r.half is not None]
    assert values == sorted(values, reverse=nulls_at == 0)


def test_four_orders_rank_all_rows(spark):
    rows = QUERIES["sort_all_four_ways"](spark, "/root/testdata/sf0.01").collect()
    for way in "abcd":
        assert sorted(r[way] for r in rows) == list(range(1, 15_001))
    nulls = [r for r in rows if r.o_orderkey % 3 == 0]
    assert max(r.a for r in nulls) == max(r.c for r in nulls) == 5_000 and min(r.b for r in nulls) == min(r.d for r in nulls) == 10_001


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_checked_integers(spark):
    n = lambda v: F.lit(v).cast("bigint")
    least = -(1 << 63)
    assert one(spark, arithmetic("/", n(-7), n(2))) == -3 and one(spark, arithmetic("/", n(7), n(-2))) == -3
    assert one(spark, arithmetic("+", n(None), n(2))) is None and one(spark, negate(n(None))) is None
    for bad in (negate(n(least)), arithmetic("/", n(1), n(0)), arithmetic("/", n(least), n(-1)), arithmetic("*", n(least), n(2)), arithmetic("+", n(least), n(-1)), arithmetic("-", n(least), n(1))):
        with pytest.raises(Exception, match="(?i)overflow|zero"):
            one(spark, bad)


def test_verdicts():
    v = sequences.verdict
    assert [v(None, None, s, "h") for s in (1, 2)] == ["new", "first_not_one"]
    assert [v(3, "h", s, h) for s, h in ((4, "x"), (3, "h"), (3, "x"), (5, "h"), (2, "h"))] == ["new", "duplicate", "hash_mismatch", "gap", "too_old"]


def ops(*rows):
    return [dict(zip(("op", "key", "input", "output", "start", "end"), r, strict=True)) for r in rows]


def test_linearizable():
    assert checkers.linearizable(ops(("put", "x", 1, None, 0, 1), ("get", "x", None, 1, 2, 3)))
    assert not checkers.linearizable(ops(("put", "x", 1, None, 0, 1), ("get", "x", None, None, 2, 3)))
    assert checkers.linearizable(ops(("put", "x", 1, None, 0, 9), ("get", "x", None, None, 2, 3), ("get", "x", None, 1, 4, 5)))
    assert not checkers.linearizable(ops(("put", "x", 1, None, 0, 9), ("get", "x", None, 1, 2, 3), ("get", "x", None, None, 4, 5)))
    assert checkers.linearizable(ops(("put", "x", 1, None, 0, 1), ("cas", "x", [1, 2], True, 2, 3), ("cas", "x", [1, 3], False, 4, 5), ("get", "x", None, 2, 6, 7)))
    assert not checkers.linearizable(ops(("put", "x", 1, None, 0, 1), ("cas", "x", [1, 2], False, 2, 3)))
    with pytest.raises(ValueError):
        checkers.linearizable(ops(*[("get", "x", None, None, 0, 1)] * 64))


def test_linearizable_histories(spark):
    rows = [(1, "put", "x", "1", None, None, 0, 1), (1, "get", "x", None, None, "1", 2, 3), (2, "put", "x", "1", None, None, 0, 1), (2, "get", "x", None, None, "2", 2, 3), (3, "cas", "x", "2", "1", "false", 0, 1)]
    df = spark.createDataFrame(rows, "history long, op string, key string, input string, expected string, output string, start long, end long")
    assert {r.history: r.linearizable for r in checkers.linearizable_histories(df).collect()} == {1: True, 2: False, 3: True}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 4, None, 2, 3, 3)], "v long")
    r = checkers.nearest_rank(df, "v", [0.0, 0.5, 0.95, 1.0]).first()
    assert (r["count"], r["min"], r["max"], r["mean"], r["p0"], r["p50"], r["p95"], r["p100"]) == (6, 1, 5, 3.0, 1, 3, 5, 5)
    assert [checkers.percentile([5, 1, 4, 2, 3], q) for q in (0.0, 0.5, 1.0)] == [1, 3, 5]
    r = checkers.nearest_rank(df.limit(0), "v", [0.5]).first()
    assert (r["count"], r["p50"]) == (0, None)
    assert checkers.nearest_rank(df.limit(0).withColumn("g", F.lit(1)), "v", [0.5], ["g"]).count() == 0


def test_schemas_refuse_what_cannot_be():
    c = lambda n, **k: Column(n, DataType.INT64, **k)
    for bad in ((), (c("a"),), (c("a", nullable=False, primary_key=True), c("A")), (c("", nullable=False, primary_key=True),), (c("a", primary_key=True),)):
        with pytest.raises(EngineError):
            Schema(bad)
