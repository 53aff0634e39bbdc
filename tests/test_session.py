"""Statements end to end: tables, indexes, constraints, transactions, locks, recovery."""

import subprocess
import sys
import textwrap
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.errors import SqlError
from quarry.session import Engine
from quarry.sources.locks import EXCLUSIVE, SHARED, UPDATE, Locks

SALES = """CREATE TABLE sales (id INT PRIMARY KEY, who VARCHAR(20), amount FLOAT, land VARCHAR(20)) USING {};"""
ROWS = [(i + 1, ["Ana", "Beto", "Caro"][i % 3], float(i), ["AR", "BR", "MX"][i % 3]) for i in range(40)]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/w", patience=0.5)


def made(engine, organisation="HEAP"):
    s = engine.session()
    s.sql(SALES.format(organisation))
    s.insert_rows("sales", ROWS)
    return s


def rows(s, text):
    return [tuple(r) for r in s.one(text).rows()]


def refused(s, text, kind):
    with pytest.raises(SqlError) as e:
        s.sql(text)
    assert e.value.kind == kind, e.value


def test_an_index_never_changes_an_answer(engine):
    s = made(engine)
    asked = ["SELECT id FROM sales WHERE land = 'AR' AND who = 'Ana'", "SELECT id FROM sales WHERE land = 'BR' OR amount BETWEEN 3 AND 9", "SELECT id FROM sales WHERE amount >= 30.0 AND land != 'MX'", "SELECT id FROM sales ORDER BY amount DESC LIMIT 4"]
    before = [sorted(rows(s, q)) for q in asked]
    s.sql("CREATE INDEX ON sales (land) USING BITMAP; CREATE INDEX ON sales (who) USING HASH; CREATE INDEX ON sales (amount) USING BTREE")
    assert [sorted(rows(s, q)) for q in asked] == before
    assert rows(s, "SELECT index_name FROM sys_indexes ORDER BY index_name") == [("idx_sales_amount_unclustered",), ("idx_sales_land_bitmap",), ("idx_sales_who_hash",)]
    plan = "\n".join(r[0] for r in s.one("EXPLAIN SELECT id FROM sales WHERE land = 'AR' ORDER BY id LIMIT 2").rows())
    for label in ("Limit", "Sort Key: id", "idx_sales_land_bitmap", "Filter: land = 'AR'", "rows=", "Planning Time:"):
        assert label in plan
    plan = "\n".join(r[0] for r in s.one("EXPLAIN ANALYZE SELECT id FROM sales WHERE land = 'AR'").rows())
    assert "Rows Removed by Filter: 26" in plan and "Execution Time:" in plan
    s.drop_index("idx_sales_who_hash")
    refused(s, "CREATE INDEX ON sales (land) USING BITMAP", "semantic")


def test_rules_of_indexes(engine):
    s = engine.session()
    s.sql("CREATE TABLE h (id INT PRIMARY KEY, p POINT) USING HEAP; CREATE TABLE q (id INT PRIMARY KEY, p POINT, n INT) USING SEQUENTIAL")
    s.sql("CREATE INDEX ON h (p) USING RTREE; CREATE INDEX ON q (id) USING BTREE CLUSTERED; CREATE INDEX ON q (n) USING BTREE")
    for bad in ("h (id) USING RTREE", "h (p) USING BTREE", "h (id) USING BTREE CLUSTERED", "q (p) USING RTREE", "q (id) USING HASH", "q (n) USING BITMAP", "q (n) USING BTREE CLUSTERED", "h (z) USING BTREE", "x (id) USING BTREE"):
        refused(s, f"CREATE INDEX ON {bad}", "semantic")


def test_sequential_tables_come_in_the_order_of_their_key(engine):
    s = engine.session()
    s.sql(SALES.format("SEQUENTIAL"))
    for i in (3, 1, 2, 5, 4):
        s.sql(f"INSERT INTO sales VALUES ({i}, 'x', 1.0, 'AR')")
    assert [r[0] for r in rows(s, "SELECT id FROM sales")] == [1, 2, 3, 4, 5]
    s.sql("DELETE FROM sales WHERE id = 3; INSERT INTO sales VALUES (3, 'again', 1.0, 'AR')")
    assert rows(s, "SELECT who FROM sales WHERE id = 3") == [("again",)]


def test_values(engine):
    s = engine.session()
    s.sql("CREATE TABLE v (s VARCHAR(4), id INT PRIMARY KEY, f FLOAT, b BOOL, d DATE, p POINT) USING HEAP; INSERT INTO v VALUES ('ñandú', 1, 0.1, FALSE, 1, POINT(1, 2)); INSERT INTO v VALUES ('b', -2, 3, TRUE, '2024-02-29', POINT(0, 0))")
    assert rows(s, "SELECT s FROM v WHERE id = 1") == [("ñan",)]
    assert rows(s, "SELECT id FROM v WHERE f = 0.1") == [] and rows(s, "SELECT id FROM v WHERE f = 3") == [(-2,)]
    assert rows(s, "SELECT id FROM v WHERE b = FALSE") == [(1,)] and rows(s, "SELECT id FROM v WHERE p = POINT(1.0, 2)") == [(1,)]
    assert rows(s, "SELECT id FROM v WHERE d = 1") == [(1,)] and rows(s, "SELECT id FROM v WHERE d > '2024-01-01'") == [(-2,)]
    for bad in ("('x', 3, 'y', TRUE, 1, POINT(0,0))", "(1, 3, 1.0, TRUE, 1, POINT(0,0))", "('x', 3, 1.0, 1, 1, POINT(0,0))", "('x', 3, 1.0, TRUE, 1, 2)", "('x', 99999999999, 1.0, TRUE, 1, POINT(0,0))", "('x', 3)"):
        refused(s, f"INSERT INTO v VALUES {bad}", "semantic")
    refused(s, "UPDATE v SET p = 3 WHERE id = 1", "semantic")
    refused(s, "INSERT INTO v VALUES ('x', 1, 1.0, TRUE, 1, POINT(0,0))", "constraint")


@pytest.mark.parametrize(
    "text",
    ["SELECT x FROM sales", "SELECT * FROM nope", "SELECT b.id FROM sales", "SELECT * FROM sales WHERE id = 'x'", "SELECT id, COUNT(*) FROM sales", "SELECT id, COUNT(*) FROM sales GROUP BY who", "SELECT SUM(who) FROM sales", "SELECT AVG(land) FROM sales", "SELECT * FROM sales GROUP BY who", "SELECT who, COUNT(*) FROM sales GROUP BY who ORDER BY id", "SELECT id FROM sales JOIN other ON id = id", "SELECT * FROM sales JOIN other ON other.id = sales.id", "SELECT who FROM sales JOIN sales ON id = id", "SELECT * FROM sales JOIN other ON sales.who = other.id", "SELECT * FROM sales WHERE distancia(who, POINT(0,0)) < 1", "UPDATE sales SET who = 'a', who = 'b' WHERE id = 1", "UPDATE sales SET z = 1 WHERE id = 1", "DROP TABLE sys_tables", "DELETE FROM sys_tables WHERE table_id = 1", "CREATE TABLE sales (id INT PRIMARY KEY) USING HEAP", "CREATE TABLE k (id INT) USING HEAP", "CREATE TABLE k (id INT PRIMARY KEY, id INT) USING HEAP"],
)
def test_refusals(spark, tmp_path_factory, text):
    global _shared
    if "_shared" not in globals() or _shared.spark is not spark:
        _shared = Engine(spark, f"file://{tmp_path_factory.mktemp('r')}/w")
        made(_shared).sql("CREATE TABLE other (id INT PRIMARY KEY, note VARCHAR(9)) USING HEAP")
    refused(_shared.session(), text, "semantic")


def test_joins_and_groups(engine):
    s = made(engine)
    s.sql("CREATE TABLE dept (id INT PRIMARY KEY, d VARCHAR(20)) USING HEAP; INSERT INTO dept VALUES (1, 'IA'); INSERT INTO dept VALUES (2, 'DB')")
    r = s.one("SELECT * FROM sales JOIN dept ON sales.id = dept.id ORDER BY amount DESC")
    assert r.columns == ["id", "who", "amount", "land", "id", "d"] and [tuple(x) for x in r.rows()] == [(2, "Beto", 1.0, "BR", 2, "DB"), (1, "Ana", 0.0, "AR", 1, "IA")]
    r = s.one("SELECT COUNT(*), who, MAX(amount), COUNT(who), MIN(land) FROM sales WHERE id <= 4 GROUP BY who ORDER BY who DESC LIMIT 2")
    assert r.columns == ["count(*)", "who", "max_agg(amount)", "count(who)", "min_agg(land)"]
    assert [tuple(x) for x in r.rows()] == [(1, "Caro", 2.0, 1, "MX"), (1, "Beto", 1.0, 1, "BR")]
    assert rows(s, "SELECT COUNT(*), SUM(amount) FROM sales WHERE id > 100") == []
    assert sorted(rows(s, "SELECT land FROM sales GROUP BY land")) == [("AR",), ("BR",), ("MX",)]


def test_changes(engine):
    s = made(engine)
    assert [r.affected_rows for r in s.sql("UPDATE sales SET amount = 7, who = 'Zoe' WHERE land = 'AR'; DELETE FROM sales WHERE who = 'Zoe' OR id = 2; DELETE FROM sales WHERE id = 999")] == [14, 15, 0]
    assert rows(s, "SELECT COUNT(*) FROM sales") == [(25,)]
    refused(s, "UPDATE sales SET id = 3 WHERE land = 'BR'", "constraint")
    assert rows(s, "SELECT COUNT(*) FROM sales") == [(25,)]
    s.optimize("sales")
    assert rows(s, "SELECT COUNT(*) FROM sales") == [(25,)]


def test_constraints(engine):
    s = engine.session()
    s.sql("CREATE TABLE people (id INT PRIMARY KEY, mail VARCHAR(50), age INT, phone INT) USING HEAP")
    s.constrain("people", not_null=["phone"], unique=["mail"], checks={"adult": "age >= 18"})
    s.sql("INSERT INTO people VALUES (1, 'a', 20, 1)")
    for bad in ("(1, 'b', 20, 1)", "(2, 'a', 20, 1)", "(2, 'b', 17, 1)"):
        refused(s, f"INSERT INTO people VALUES {bad}", "constraint")
    with pytest.raises(SqlError):
        s.insert_rows("people", engine.spark.createDataFrame([(5, "e", 30, None)], "id int, mail string, age int, phone int"))
    s.sql("INSERT INTO people VALUES (2, 'b', 18, 1)")
    refused(s, "UPDATE people SET mail = 'a' WHERE id = 2", "constraint")
    refused(s, "UPDATE people SET age = 3 WHERE id = 2", "constraint")
    assert len(rows(s, "SELECT * FROM people")) == 2


def test_transactions(engine):
    s, other = made(engine), engine.session()
    s.sql("BEGIN TRANSACTION; INSERT INTO sales VALUES (100, 'N', 1.0, 'AR'); DELETE FROM sales WHERE id = 1")
    assert rows(s, "SELECT COUNT(*) FROM sales WHERE id = 100 OR id = 1") == [(1,)]
    refused(other, "SELECT * FROM sales", "lock")
    s.sql("ROLLBACK")
    assert rows(other, "SELECT COUNT(*) FROM sales WHERE id = 100 OR id = 1") == [(1,)] and rows(other, "SELECT id FROM sales WHERE id = 100") == []
    s.sql("BEGIN TRANSACTION; INSERT INTO sales VALUES (100, 'N', 1.0, 'AR'); CREATE TABLE t (id INT PRIMARY KEY) USING HEAP; END TRANSACTION")
    assert rows(other, "SELECT id FROM sales WHERE id = 100") == [(100,)] and rows(other, "SELECT * FROM t") == []
    s.sql("BEGIN TRANSACTION; DROP TABLE t")
    refused(s, "INSERT INTO sales VALUES (100, 'dup', 1.0, 'AR')", "constraint")
    assert s.open is None and rows(other, "SELECT * FROM t") == []
    refused(s, "END TRANSACTION", "transaction")
    refused(s, "ROLLBACK", "transaction")
    refused(s, "BEGIN TRANSACTION; BEGIN TRANSACTION", "transaction")
    status = sorted(r.status for r in engine.transactions().collect())
    assert status == ["aborted"] * 3 + ["committed"]
    assert engine.events().where("type = 'INSERT'").count() == 2
    assert engine.lock_table().count() == 0


def test_locks():
    locks = Locks(patience=0.2)
    locks.take("a", "t", SHARED)
    locks.take("b", "t", SHARED)
    locks.take("a", "t", UPDATE)
    for owner, mode in (("b", EXCLUSIVE), ("c", UPDATE), ("c", EXCLUSIVE)):
        with pytest.raises(SqlError):
            locks.take(owner, "t", mode)
    locks.free("b")
    locks.take("a", "t", EXCLUSIVE)
    locks.take("a", "t", SHARED)
    with pytest.raises(SqlError):
        locks.take("c", "t", SHARED)
    done = []
    waiter = threading.Thread(target=lambda: (Locks.take(patient, "c", "t", SHARED), done.append(1)))
    patient = locks
    patient.patience = 5
    waiter.start()
    time.sleep(0.1)
    locks.free("a")
    waiter.join(5)
    assert done == [1] and locks.listing() == [("t", "c", SHARED)]


def test_what_was_committed_outlives_a_crash(spark, tmp_path):
    program = f"""
    import os, sys
    sys.path[:0] = {sys.path!r}
    from pyspark.sql import SparkSession
    from quarry.session import Engine
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    s = Engine(spark, "file://{tmp_path}/w").session()
    s.sql("CREATE TABLE t (id INT PRIMARY KEY) USING HEAP; INSERT INTO t VALUES (1); BEGIN TRANSACTION; INSERT INTO t VALUES (2); DELETE FROM t WHERE id = 1")
    os._exit(3)
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(program)], capture_output=True, timeout=300).returncode == 3
    engine = Engine(spark, f"file://{tmp_path}/w")
    assert len(engine.recover()) >= 1
    s = engine.session()
    assert rows(s, "SELECT id FROM t") == [(1,)]
    s.sql("INSERT INTO t VALUES (2)")
    assert sorted(rows(s, "SELECT id FROM t")) == [(1,), (2,)]


def test_two_sessions_on_two_tables(engine):
    a, b = made(engine), engine.session()
    b.sql("CREATE TABLE t (id INT PRIMARY KEY) USING HEAP; BEGIN TRANSACTION; INSERT INTO t VALUES (1)")
    a.sql("INSERT INTO sales VALUES (200, 'x', 1.0, 'AR')")
    b.sql("END TRANSACTION")
    assert rows(a, "SELECT id FROM t") == [(1,)] and rows(a, "SELECT id FROM sales WHERE id = 200") == [(200,)]


def test_a_stream_is_inserted_once(engine, spark, tmp_path):
    from quarry.streaming.appends import append

    engine.session().sql("CREATE TABLE e (id INT PRIMARY KEY, w VARCHAR(9)) USING HEAP; INSERT INTO e VALUES (0, 'old')")
    spark.createDataFrame([(i, f"w{i}") for i in range(1, 30)], "id int, w string").repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append(spark.readStream.schema("id int, w string").parquet(f"{tmp_path}/in"), engine, "e", f"{tmp_path}/c").awaitTermination()
    s = engine.session()
    assert rows(s, "SELECT COUNT(*) FROM e") == [(30,)] and rows(s, "SELECT w FROM e WHERE id = 0") == [("old",)]
    some = spark.createDataFrame([(100, "x")], "id int, w string")
    assert [s.insert_rows("e", some, ("stream", n)) for n in (0, 0)] == [1, 0]
    with pytest.raises(SqlError, match="repeat"):
        s.insert_rows("e", some, ("stream", 1))
    assert rows(s, "SELECT COUNT(*) FROM e") == [(31,)]


def test_an_order_that_files_have_needs_no_exchange(engine):
    s = made(engine, "SEQUENTIAL")
    for text, want in (("SELECT id FROM sales", range(1, 41)), ("SELECT id FROM sales ORDER BY id DESC", range(40, 0, -1)), ("SELECT id FROM sales WHERE id > 5 ORDER BY id LIMIT 3", (6, 7, 8))):
        r = s.one(text)
        assert [x[0] for x in r.rows()] == list(want)
        assert "Exchange rangepartitioning" not in r.df._jdf.queryExecution().toString()
    h = engine.session()
    h.sql("CREATE TABLE lands (id INT PRIMARY KEY, land VARCHAR(2)) USING HEAP; CREATE INDEX ON lands (land) USING BTREE")
    h.insert_rows("lands", [(i, ["AR", "BR", "MX"][i % 3]) for i in range(30, 0, -1)])
    r = h.one("SELECT id FROM lands ORDER BY land DESC LIMIT 12")
    assert [x[0] for x in r.rows()] == [*range(2, 31, 3), 1, 4] and "Exchange rangepartitioning" not in r.df._jdf.queryExecution().toString()
    s.sql("BEGIN TRANSACTION; INSERT INTO sales VALUES (0, 'x', 1.0, 'AR')")
    assert [x[0] for x in s.one("SELECT id FROM sales LIMIT 2").rows()] == [0, 1]
    s.sql("END TRANSACTION")
    assert [x[0] for x in s.one("SELECT id FROM sales ORDER BY id LIMIT 2").rows()] == [0, 1]


def test_a_sequential_table_is_rewritten_when_much_lies_in_later_folders(engine):
    s = made(engine, "SEQUENTIAL")
    for i in range(3):
        s.sql(f"INSERT INTO sales VALUES ({100 + i}, 'x', 1.0, 'AR')")
    assert len(engine.store.latest()[1]["sales"].parts) == 1
    assert rows(s, "SELECT COUNT(*) FROM sales") == [(43,)]


def test_the_api_locks_and_takes_part_in_transactions(engine):
    s, other = made(engine), engine.session()
    s.sql("CREATE INDEX ON sales (land) USING BITMAP; BEGIN TRANSACTION")
    s.drop_index("idx_sales_land_bitmap")
    with pytest.raises(SqlError):
        other.optimize("sales")
    refused(other, "EXPLAIN SELECT * FROM sales", "lock")
    s.sql("ROLLBACK")
    assert rows(s, "SELECT index_name FROM sys_indexes") == [("idx_sales_land_bitmap",)]
    other.optimize("sales")
    assert engine.health() | {"manifest": 0} == {"status": "ok", "manifest": 0, "tables": 1, "open_transactions": 0, "locks": 0}
    assert engine.recovery_status().count() == 0 and engine.recover() and engine.recovery_status().count() > 0


def test_a_geodesic_radius_reaches_the_scan(engine):
    s = engine.session()
    s.sql("CREATE TABLE p (id INT PRIMARY KEY, at POINT) USING HEAP; INSERT INTO p VALUES (1, POINT(-77, -12)); INSERT INTO p VALUES (2, POINT(10, 50))")
    asked = "SELECT id FROM p WHERE distancia_geodesica(at, POINT(-77, -12)) < 9000"
    assert rows(s, asked) == [(1,)]
    assert "at.x" in s.one(asked).df._jdf.queryExecution().toString().split("PushedFilters")[1]
    s.sql("INSERT INTO p VALUES (3, POINT(10, 95))")
    with pytest.raises(Exception, match="longitude"):
        rows(s, asked)


def test_points_feed(engine):
    s = engine.session()
    engine.attach("places", engine.spark.range(3).select(F.col("id").alias("lon"), F.col("id").alias("lat")))
    assert s.spatial_points("places").count() == 3 and rows(s, "SELECT lon FROM places WHERE lat = 2") == [(2,)]
    refused(s, "DELETE FROM places WHERE lon = 1", "semantic")
