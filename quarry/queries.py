"""A query for each operator of the engine over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import SqlError
from quarry.functions import spatial
from quarry.functions.text import STOP_WORDS, tokens
from quarry.operators import keysets
from quarry.operators.retrieval import Index, as_maps, bag, show
from quarry.plans import planner
from quarry.plans.parser import parse
from quarry.plans.tree import dump
from quarry.session import Engine
from quarry.sources import constraints
from quarry.sources.folders import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(df: DataFrame, key: str) -> DataFrame:
    """A POINT column from a key: whole numbers first, then one division, so that every engine gets the same bits."""
    x = ((F.col(key) * 7919) % 360000).cast("double") / 1000.0 - 180.0
    y = ((F.col(key) * 104729) % 180000).cast("double") / 1000.0 - 90.0
    return df.withColumn("location", spatial.point(x, y))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, planner.Table]:
    out = {n: planner.Table(n, table(spark, sf_dir, n), KEYS.get(n)) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        out[f"{name}_at"] = planner.Table(f"{name}_at", located(out[name].frame, key), key)
    target = located(out["nation"].frame, "n_nationkey").select("n_nationkey", F.col("location").alias("target"))
    routes = out["customer_at"].frame.withColumnRenamed("location", "origin").join(target, F.col("c_nationkey") == F.col("n_nationkey"))
    out["routes"] = planner.Table("routes", routes.select("c_custkey", "n_nationkey", "origin", "target"), "c_custkey")
    return out


def dialect(name: str, statement: str, columns: str, oracle: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query written in the dialect; `columns` names what it gives, `then` shapes it for the comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, _ = planner.select(parse(statement)[0], tables(spark, sf_dir), standard_empty=True)
        return then(df.toDF(*columns.split()))

    QUERIES[name], ORACLE[name] = run, oracle


def rounded(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, 3) for n in names})


# --- scans, projections, predicates
N, O, L, C = "n_nationkey n_name n_regionkey", "o_orderkey o_totalprice", "l_orderkey l_linenumber l_quantity", "c_custkey c_mktsegment"
dialect("scan_all", "SELECT * FROM lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "SELECT * FROM lineitem")
dialect("scan_small", "SELECT * FROM nation", N, "SELECT * FROM nation")
dialect("project_cols", "SELECT c_custkey, customer.c_mktsegment FROM customer", C, "SELECT c_custkey, c_mktsegment FROM customer")
for _name, _table, _columns, _where in (
    ("filter_eq", "lineitem", L, "l_quantity = 17"),
    ("filter_ne", "orders", O, "o_orderstatus != 'O'"),
    ("filter_lt", "orders", O, "o_totalprice < 50000.5"),
    ("filter_le", "lineitem", L, "l_quantity <= 3"),
    ("filter_gt", "orders", O, "o_totalprice > 200000"),
    ("filter_ge", "lineitem", L, "l_quantity >= 48"),
    ("filter_between", "lineitem", L, "l_quantity BETWEEN 10 AND 12"),
    ("filter_str_eq", "customer", C, "c_mktsegment = 'BUILDING'"),
    ("filter_str_between", "customer", C, "c_mktsegment BETWEEN 'B' AND 'G'"),
    ("filter_and", "lineitem", L, "l_returnflag = 'R' AND l_quantity > 40"),
    ("filter_or", "lineitem", L, "l_returnflag = 'R' OR l_quantity > 45"),
    ("filter_precedence", "lineitem", L, "l_returnflag = 'R' OR l_linestatus = 'O' AND l_quantity < 5"),
    ("filter_paren", "lineitem", L, "(l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity < 5"),
):
    _sql = f"SELECT {', '.join(_columns.split())} FROM {_table} WHERE {_where}"
    dialect(_name, _sql, _columns, _sql)

# --- joins
dialect("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "n_name r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql = "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 150000 AND c_mktsegment = 'MACHINERY'"
dialect("join_where", _sql, "o_orderkey c_mktsegment", _sql)
_sql = "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC"
dialect("join_order_limit", _sql + " LIMIT 20", "o_orderkey o_totalprice c_name", _sql + ", o_orderkey, c_custkey LIMIT 20")
dialect("join_group", "SELECT c_mktsegment, COUNT(*), SUM(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "c_mktsegment n total", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", rounded("total"))

# --- aggregates
for _name, _call, _sql in (
    ("agg_count_star", "COUNT(*)", "count(*)"),
    ("agg_count_col", "COUNT(o_custkey)", "count(o_custkey)"),
    ("agg_sum", "SUM(o_totalprice)", "round(sum(o_totalprice), 3)"),
    ("agg_avg", "AVG(o_totalprice)", "round(avg(o_totalprice), 3)"),
    ("agg_min", "MIN(o_totalprice)", "min(o_totalprice)"),
    ("agg_max", "MAX(o_totalprice)", "max(o_totalprice)"),
):
    dialect(_name, f"SELECT {_call} FROM orders", "v", f"SELECT {_sql} AS v FROM orders", rounded("v") if _name in ("agg_sum", "agg_avg") else lambda df: df)
_all, _sums = "COUNT(*), SUM(l_quantity), AVG(l_extendedprice), MIN(l_quantity), MAX(l_quantity)", "count(*) AS n, round(sum(l_quantity), 3) AS total, round(avg(l_extendedprice), 3) AS mean, min(l_quantity) AS low, max(l_quantity) AS high"
dialect("agg_global_all", f"SELECT {_all} FROM lineitem", "n total mean low high", f"SELECT {_sums} FROM lineitem", rounded("total", "mean"))
dialect("agg_empty_input", f"SELECT {_all} FROM lineitem WHERE l_quantity < 0", "n total mean low high", f"SELECT {_sums} FROM lineitem WHERE l_quantity < 0", rounded("total", "mean"))
dialect("group_count", "SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment", "c_mktsegment n", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
dialect("group_all_aggs", f"SELECT l_returnflag, {_all} FROM lineitem GROUP BY l_returnflag", "l_returnflag n total mean low high", f"SELECT l_returnflag, {_sums} FROM lineitem GROUP BY 1", rounded("total", "mean"))
dialect("group_where", "SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag", "l_returnflag n", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
dialect("group_order", "SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority DESC LIMIT 3", "o_orderpriority n", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
dialect("group_only_distinct", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority", "o_orderpriority", "SELECT DISTINCT o_orderpriority FROM orders")

# --- order and limit
dialect("order_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice", O, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1")
dialect("order_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC", O, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1")
dialect("order_string", "SELECT n_name FROM nation ORDER BY n_name", "n_name", "SELECT n_name FROM nation ORDER BY 1")
dialect("limit_zero", "SELECT n_name FROM nation LIMIT 0", "n_name", "SELECT n_name FROM nation LIMIT 0")
dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 10", O, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY 2 DESC, 1 LIMIT 10")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- algebra of masks
def _mask(name: str, mask: Callable[[Column, Column, Column], Column], oracle: str) -> None:
    @query(name, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {oracle}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r, o, q = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity").between(10, 20)
        return table(spark, sf_dir, "lineitem").where(mask(r, o, q)).select("l_orderkey", "l_linenumber")


_mask("bitmap_and", lambda r, o, q: keysets.intersect(r, q), "l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20")
_mask("bitmap_or", lambda r, o, q: keysets.union(r, o), "l_returnflag = 'R' OR l_linestatus = 'O'")
_mask("bitmap_and_or_nested", lambda r, o, q: keysets.intersect(keysets.union(r, o), q), "(l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity BETWEEN 10 AND 20")
_mask("bitmap_difference", lambda r, o, q: keysets.difference(q, r), "l_quantity BETWEEN 10 AND 20 AND NOT l_returnflag = 'R'")


@query("keyset_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = keysets.keys(table(spark, sf_dir, "customer"), "c_custkey", F.lit(True)).toDF("k")
    return customers.exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct())


# --- spatial
def _xy(key: str) -> str:
    return f"(({key} * 7919) % 360000)::DOUBLE / 1000.0::DOUBLE - 180.0::DOUBLE AS x, (({key} * 104729) % 180000)::DOUBLE / 1000.0::DOUBLE - 90.0::DOUBLE AS y"


CUSTOMERS = f"(SELECT c_custkey, c_mktsegment, c_nationkey, {_xy('c_custkey')} FROM customer)"
NATIONS = f"(SELECT n_nationkey, {_xy('n_nationkey')} FROM nation)"
SUPPLIERS = f"(SELECT s_suppkey, s_nationkey, {_xy('s_suppkey')} FROM supplier)"


def _plane(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"sqrt(({x0} - {x1}) * ({x0} - {x1}) + ({y0} - {y1}) * ({y0} - {y1}))"


def _sphere(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({y1}) - radians({y0})) / 2), 2) + cos(radians({y0})) * cos(radians({y1})) * pow(sin(radians({x1} - {x0}) / 2), 2))))"


LX, LY = "(-77.0428)::DOUBLE", "(-12.0464)::DOUBLE"


def _distances(name: str, metric: str, sql: Callable[[str, str, str, str], str]) -> None:
    @query(name, f"SELECT c_custkey, round({sql('x', 'y', LX, LY)}, 3) AS d FROM {CUSTOMERS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = located(table(spark, sf_dir, "customer"), "c_custkey")
        return df.select("c_custkey", F.round(spatial.distance(metric, F.col("location"), (-77.0428, -12.0464)), 3).alias("d"))


_distances("dist_euclidean", spatial.EUCLIDEAN, _plane)
_distances("dist_geodesic", spatial.GEODESIC, _sphere)


@query("dist_col_col", f"SELECT c_custkey, n_nationkey, round({_sphere('c.x', 'c.y', 'n.x', 'n.y')}, 3) AS d FROM {CUSTOMERS} c JOIN {NATIONS} n ON c_nationkey = n_nationkey")
def _col_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = tables(spark, sf_dir)["routes"].frame
    return routes.select("c_custkey", "n_nationkey", F.round(spatial.geodesic(F.col("origin"), F.col("target")), 3).alias("d"))


_K = "c_custkey"
dialect("radius_euclidean", "SELECT c_custkey FROM customer_at WHERE distancia(location, POINT(-77.0428, -12.0464)) <= 20", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE {_plane('x', 'y', LX, LY)} <= 20")
dialect("radius_geodesic", "SELECT c_custkey FROM customer_at WHERE distancia_geodesica(location, POINT(-77.0428, -12.0464)) < 3000000", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE {_sphere('x', 'y', LX, LY)} < 3000000")
dialect("dist_col_col_filter", "SELECT c_custkey, n_nationkey FROM routes WHERE distancia_geodesica(origin, target) > 15000000", "c_custkey n_nationkey", f"SELECT c_custkey, n_nationkey FROM {CUSTOMERS} c JOIN {NATIONS} n ON c_nationkey = n_nationkey WHERE {_sphere('c.x', 'c.y', 'n.x', 'n.y')} > 15000000")
dialect("knn_euclidean", "SELECT c_custkey FROM customer_at ORDER BY distancia(location, POINT(-77.0428, -12.0464)) LIMIT 10", _K, f"SELECT c_custkey FROM {CUSTOMERS} ORDER BY {_plane('x', 'y', LX, LY)}, 1 LIMIT 10")
dialect("knn_geodesic", "SELECT c_custkey FROM customer_at ORDER BY distancia_geodesica(location, POINT(-77.0428, -12.0464)) LIMIT 10", _K, f"SELECT c_custkey FROM {CUSTOMERS} ORDER BY {_sphere('x', 'y', LX, LY)}, 1 LIMIT 10")
dialect("knn_filtered", "SELECT c_custkey FROM customer_at WHERE c_mktsegment = 'BUILDING' ORDER BY distancia(location, POINT(-77.0428, -12.0464)) ASC LIMIT 10", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' ORDER BY {_plane('x', 'y', LX, LY)}, 1 LIMIT 10")
dialect("farthest_k", "SELECT c_custkey FROM customer_at ORDER BY distancia(location, POINT(-77.0428, -12.0464)) DESC LIMIT 10", _K, f"SELECT c_custkey FROM {CUSTOMERS} ORDER BY {_plane('x', 'y', LX, LY)} DESC, 1 LIMIT 10")

SQUARE, CORNER = [(-90, -40), (20, -40), (20, 30), (-90, 30)], [(-150, -60), (60, -60), (60, -10), (-40, -10), (-40, 55), (-150, 55)]


def _inside(vertices: list[tuple[int, int]]) -> str:
    """How many edges a ray crosses, odd or even."""
    edges = []
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi != yj:
            edges.append(f"CASE WHEN (({yi} > y) <> ({yj} > y)) AND x < ({xj - xi})::DOUBLE * (y - ({yi})) / ({yj - yi})::DOUBLE + ({xi}) THEN 1 ELSE 0 END")
    return f"({' + '.join(edges)}) % 2 = 1"


def _polygon(vertices: list[tuple[int, int]]) -> str:
    return f"dentro_de(location, POLYGON({', '.join(f'POINT({x}, {y})' for x, y in vertices)}))"


dialect("polygon_convex", f"SELECT c_custkey FROM customer_at WHERE {_polygon(SQUARE)}", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE {_inside(SQUARE)}")
dialect("polygon_concave", f"SELECT c_custkey FROM customer_at WHERE {_polygon(CORNER)}", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE {_inside(CORNER)}")
dialect("polygon_and_attr", f"SELECT c_custkey FROM customer_at WHERE {_polygon(CORNER)} AND c_mktsegment = 'FURNITURE'", _K, f"SELECT c_custkey FROM {CUSTOMERS} WHERE {_inside(CORNER)} AND c_mktsegment = 'FURNITURE'")


@query("mbr_range", f"SELECT c_custkey, x, y FROM {CUSTOMERS} WHERE x BETWEEN -100 AND 40 AND y BETWEEN -50 AND 50")
def _mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = located(table(spark, sf_dir, "customer"), "c_custkey").where(spatial.in_rectangle(F.col("location"), -100, -50, 40, 50))
    return df.select("c_custkey", "location.x", "location.y")


@query("mbr_of_group", f"SELECT c_mktsegment, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max, round((max(x) - min(x)) * (max(y) - min(y)), 3) AS area FROM {CUSTOMERS} GROUP BY 1")
def _mbr_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = located(table(spark, sf_dir, "customer"), "c_custkey").groupBy("c_mktsegment").agg(*spatial.rectangle(F.col("location")))
    return df.withColumn("area", F.round(spatial.area(*(F.col(c) for c in ("x_min", "y_min", "x_max", "y_max"))), 3))


@query("spatial_points", f"SELECT x, y FROM {SUPPLIERS}")
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_of(located(table(spark, sf_dir, "supplier"), "s_suppkey"))


# --- changes: a table of orders in a warehouse of its own
CREATE = "CREATE TABLE sales (id INT PRIMARY KEY, customer INT, status VARCHAR(1), priority VARCHAR(15)) USING {}"
ROWS = "SELECT o_orderkey::INT AS id, o_custkey::INT AS customer, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
NAMES = ["id", "customer", "status", "priority"]


def _warehouse(spark: SparkSession, sf_dir: str, organisation: str = "HEAP", indexes: str = "") -> Engine:
    engine = Engine(spark, fresh_path(spark, "warehouse"))
    session = engine.session()
    session.sql(CREATE.format(organisation))
    if indexes:
        session.sql(indexes)
    session.insert_rows("sales", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").toDF(*NAMES))
    return engine


def change(name: str, program: str, oracle: str, organisation: str = "HEAP") -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _warehouse(spark, sf_dir, organisation).session()
        session.sql(program)
        return session.one("SELECT * FROM sales").df


change("insert_row", "INSERT INTO sales VALUES (-100, 7, 'N', 'NONE')", ROWS + " UNION ALL SELECT -100, 7, 'N', 'NONE'")
change("update_where", "UPDATE sales SET status = 'X', customer = 9 WHERE priority = '1-URGENT' OR id < 40", "SELECT o_orderkey::INT AS id, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderkey < 40 THEN 9 ELSE o_custkey END::INT AS customer, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderkey < 40 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
change("delete_where", "DELETE FROM sales WHERE status = 'F'", ROWS + " WHERE o_orderstatus <> 'F'")
change("delete_none", "DELETE FROM sales WHERE id = -12345", ROWS)
change("delete_by_key", "DELETE FROM sales WHERE id = 7", ROWS + " WHERE o_orderkey <> 7")
change("txn_commit", "BEGIN TRANSACTION; DELETE FROM sales WHERE id < 500; INSERT INTO sales VALUES (3, 8, 'B', 'BACK'); END TRANSACTION", ROWS + " WHERE o_orderkey >= 500 UNION ALL SELECT 3, 8, 'B', 'BACK'")
change("txn_rollback", "BEGIN TRANSACTION; DELETE FROM sales WHERE id < 500; INSERT INTO sales VALUES (-300, 1, 'G', 'GONE'); ROLLBACK", ROWS)
change("sequential_scan", "INSERT INTO sales VALUES (-1, 0, 'F', 'FIRST')", ROWS + " UNION ALL SELECT -1, 0, 'F', 'FIRST' ORDER BY 1", "SEQUENTIAL")


@query("reorganize", ROWS + " WHERE o_orderstatus <> 'O'")
def _reorganize(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _warehouse(spark, sf_dir).session()
    session.sql("DELETE FROM sales WHERE status = 'O'")
    session.optimize("sales")
    return session.one("SELECT * FROM sales").df


def steps(name: str, oracle: str, organisation: str = "HEAP", indexes: str = "") -> Callable:
    """A query that does more than one program: f(engine, session) gives the rows."""

    def add(f: Callable) -> Callable:
        @query(name, oracle)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = _warehouse(spark, sf_dir, organisation, indexes)
            return f(engine, engine.session())

        return f

    return add


def _failed(session, text: str) -> str:
    """The kind of error that a program raises."""
    try:
        session.sql(text)
    except SqlError as e:
        return e.kind
    return "none"


@steps("txn_error_aborts", ROWS)
def _aborts(engine: Engine, session) -> DataFrame:
    _failed(session, "BEGIN TRANSACTION; DELETE FROM sales WHERE id < 500; SELECT nothing FROM sales")
    return session.one("SELECT * FROM sales").df


@steps("txn_undo_ddl", ROWS)
def _undo(engine: Engine, session) -> DataFrame:
    session.sql("BEGIN TRANSACTION; UPDATE sales SET customer = 1 WHERE id > 0; DROP TABLE sales; ROLLBACK")
    return session.one("SELECT * FROM sales").df


@steps("autocommit_two_sessions", "SELECT 'other session' AS who, count(*) AS n FROM orders WHERE o_orderkey > 7")
def _two(engine: Engine, session) -> DataFrame:
    session.sql("DELETE FROM sales WHERE id <= 7")
    return engine.session().one("SELECT COUNT(*) FROM sales").df.toDF("n").select(F.lit("other session").alias("who"), "n")


@steps("recovery", ROWS + " WHERE o_orderkey > 100")
def _recovery(engine: Engine, session) -> DataFrame:
    session.sql("DELETE FROM sales WHERE id <= 100; BEGIN TRANSACTION; DELETE FROM sales WHERE status = 'F'")
    again = Engine(engine.spark, engine.store.root)  # as after a crash: the open transaction is lost
    again.recover()
    return again.session().one("SELECT * FROM sales").df


@steps("locks_held", "SELECT * FROM (VALUES ('sales', 'X'), ('sales', 'S')) v(table_name, mode)")
def _locks(engine: Engine, session) -> DataFrame:
    session.sql("BEGIN TRANSACTION; SELECT * FROM sales; DELETE FROM sales WHERE id = -1")
    held = engine.lock_table().select(F.col("table").alias("table_name"), "mode")
    rows = [tuple(r) for r in held.collect()]
    session.sql("ROLLBACK")
    return engine.spark.createDataFrame(rows, held.schema)


@steps("log_events", "SELECT * FROM (VALUES ('BEGIN', 0, NULL), ('DELETE', 1, 'sales'), ('INSERT', 2, 'sales'), ('COMMIT', 3, NULL)) v(event, place, table_name)")
def _log(engine: Engine, session) -> DataFrame:
    session.sql("BEGIN TRANSACTION; DELETE FROM sales WHERE id = 1; INSERT INTO sales VALUES (1, 1, 'A', 'B'); END TRANSACTION")
    return engine.events().select(F.col("type").alias("event"), F.col("number").alias("place"), F.col("table").alias("table_name"))


@steps("health", "SELECT 'ok' AS status, 1 AS tables, 0 AS open_transactions, 0 AS locks")
def _health(engine: Engine, session) -> DataFrame:
    h = engine.health()
    return engine.spark.createDataFrame([(h["status"], h["tables"], h["open_transactions"], h["locks"])], "status string, tables int, open_transactions int, locks int")


@steps("recovery_status", "SELECT 1 AS removed, 'sales' AS table_name")
def _recovered(engine: Engine, session) -> DataFrame:
    engine.store.write("sales", engine.spark.createDataFrame([(1, 1, "L", "LOST")], session.tables(["sales"])["sales"].frame.schema), engine.store.latest()[1]["sales"])
    engine.recover()
    return engine.recovery_status().groupBy(F.split("folder", "/")[1].alias("table_name")).agg(F.count("*").cast("int").alias("removed"))


@steps("drop_table", "SELECT 'semantic' AS kind, 0 AS tables")
def _drop(engine: Engine, session) -> DataFrame:
    session.sql("DROP TABLE sales")
    return engine.spark.createDataFrame([(_failed(session, "SELECT * FROM sales"), engine.health()["tables"])], "kind string, tables int")


@steps("constraint_messages", "SELECT * FROM (VALUES (1, 'constraint'), (2, 'constraint'), (3, 'constraint'), (4, 'constraint'), (5, 'none')) v(i, kind)")
def _refused_rows(engine: Engine, session) -> DataFrame:
    session.sql("CREATE TABLE people (id INT PRIMARY KEY, mail VARCHAR(50), age INT) USING HEAP")
    session.constrain("people", not_null=["mail"], unique=["mail"], checks={"adult": "age >= 18"})
    session.sql("INSERT INTO people VALUES (1, 'a', 20)")
    kinds = [_failed(session, f"INSERT INTO people VALUES {v}") for v in ("(1, 'b', 20)", "(2, 'a', 20)", "(2, 'b', 17)")]
    kinds += [_failed(session, "UPDATE people SET age = 3 WHERE id = 1"), _failed(session, "INSERT INTO people VALUES (2, 'b', 18)")]
    return engine.spark.createDataFrame(list(enumerate(kinds, 1)), "i int, kind string")


@steps("messages", "SELECT * FROM (VALUES ('1 fila insertada', 1), ('2 fila(s) actualizada(s)', 2), ('3 fila(s) eliminada(s)', 3)) v(message, affected_rows)")
def _messages(engine: Engine, session) -> DataFrame:
    session.sql("CREATE TABLE t (id INT PRIMARY KEY, n INT) USING HEAP; INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (2, 1)")
    done = session.sql("INSERT INTO t VALUES (3, 2); UPDATE t SET n = 5 WHERE n = 1; DELETE FROM t WHERE id > 0")
    return engine.spark.createDataFrame([(r.message, r.affected_rows) for r in done], "message string, affected_rows int")


# --- indexes: each query reads a table that has them; its SQL reads the plain one
def indexed(name: str, statement: str, oracle: str, indexes: str, organisation: str = "HEAP", columns: str = "id", before: str = "") -> None:
    @steps(name, oracle, organisation, indexes)
    def run(engine: Engine, session) -> DataFrame:
        if before:
            session.sql(before)
        return session.one(statement).df.toDF(*columns.split())


_btree, _hash, _bitmaps = "CREATE INDEX ON sales (customer) USING BTREE", "CREATE INDEX ON sales (priority) USING HASH", "CREATE INDEX ON sales (status) USING BITMAP; CREATE INDEX ON sales (priority) USING BITMAP"
_clustered = "CREATE INDEX ON sales (id) USING BTREE CLUSTERED"
_ids = "SELECT o_orderkey::INT AS id FROM orders WHERE "
indexed("btree_eq", "SELECT id FROM sales WHERE customer = 22", _ids + "o_custkey = 22", _btree)
indexed("btree_range", "SELECT id FROM sales WHERE customer BETWEEN 10 AND 25", _ids + "o_custkey BETWEEN 10 AND 25", _btree)
indexed("btree_order", "SELECT id, customer FROM sales ORDER BY customer DESC LIMIT 50", "SELECT o_orderkey::INT AS id, o_custkey::INT AS customer FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 50", _btree, columns="id customer")
indexed("btree_on_sequential", "SELECT id FROM sales WHERE customer = 22 AND status = 'F'", _ids + "o_custkey = 22 AND o_orderstatus = 'F'", _btree, "SEQUENTIAL")
indexed("btree_maintained", "SELECT id FROM sales WHERE customer = 22", _ids + "o_custkey = 22 AND o_orderstatus <> 'F' UNION ALL SELECT -5", _btree, before="DELETE FROM sales WHERE status = 'F'; INSERT INTO sales VALUES (-5, 22, 'O', 'NEW')")
indexed("clustered_eq", "SELECT id FROM sales WHERE id = 32", _ids + "o_orderkey = 32", _clustered, "SEQUENTIAL")
indexed("clustered_range", "SELECT id FROM sales WHERE id BETWEEN 100 AND 900", _ids + "o_orderkey BETWEEN 100 AND 900", _clustered, "SEQUENTIAL")
indexed("clustered_order", "SELECT id FROM sales ORDER BY id DESC LIMIT 40", "SELECT o_orderkey::INT AS id FROM orders ORDER BY 1 DESC LIMIT 40", _clustered, "SEQUENTIAL")
indexed("ordered_file_search", "SELECT id, status FROM sales WHERE id = 64", "SELECT o_orderkey::INT AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 64", "", "SEQUENTIAL", "id status")
indexed("key_search", "SELECT * FROM sales WHERE id = 33", ROWS + " WHERE o_orderkey = 33", "", columns="id customer status priority")
indexed("hash_eq", "SELECT id FROM sales WHERE priority = '2-HIGH'", _ids + "o_orderpriority = '2-HIGH'", _hash)
indexed("hash_missing", "SELECT id FROM sales WHERE priority = 'NOWHERE'", _ids + "o_orderpriority = 'NOWHERE'", _hash)
indexed("bitmap_index_and", "SELECT id FROM sales WHERE status = 'F' AND priority = '5-LOW'", _ids + "o_orderstatus = 'F' AND o_orderpriority = '5-LOW'", _bitmaps)
indexed("bitmap_index_or", "SELECT id FROM sales WHERE status = 'P' OR priority = '5-LOW'", _ids + "o_orderstatus = 'P' OR o_orderpriority = '5-LOW'", _bitmaps)
indexed("bitmap_index_between", "SELECT id FROM sales WHERE priority BETWEEN '2-HIGH' AND '4' AND status != 'O'", _ids + "o_orderpriority BETWEEN '2-HIGH' AND '4' AND o_orderstatus <> 'O'", _bitmaps)
indexed("index_with_residual", "SELECT id FROM sales WHERE customer < 40 AND (status = 'F' OR priority = '1-URGENT')", _ids + "o_custkey < 40 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')", _btree + "; " + _hash)


@steps("index_reload", _ids + "o_custkey = 22", indexes=_btree)
def _reload(engine: Engine, session) -> DataFrame:
    again = Engine(engine.spark, engine.store.root).session()
    return again.one("SELECT id FROM sales WHERE customer = 22").df


@steps("index_back_fill", _ids + "o_custkey BETWEEN 10 AND 12")
def _fill(engine: Engine, session) -> DataFrame:
    session.sql(_btree)
    return session.one("SELECT id FROM sales WHERE customer BETWEEN 10 AND 12").df


@steps("index_drop", "SELECT 'idx_sales_priority_hash' AS index_name", indexes=_btree + "; " + _hash)
def _drop_index(engine: Engine, session) -> DataFrame:
    session.drop_index("idx_sales_customer_unclustered")
    return session.one("SELECT index_name FROM sys_indexes").df


@steps("index_rules", "SELECT i, 'semantic' AS kind FROM range(1, 7) r(i)")
def _rules(engine: Engine, session) -> DataFrame:
    session.sql("CREATE TABLE q (id INT PRIMARY KEY, p POINT, n INT) USING SEQUENTIAL")
    kinds = [_failed(session, f"CREATE INDEX ON {x}") for x in ("q (id) USING HASH", "q (n) USING BITMAP", "q (p) USING RTREE", "q (n) USING BTREE CLUSTERED", "sales (id) USING RTREE", "sales (nothing) USING BTREE")]
    return engine.spark.createDataFrame(list(enumerate(kinds, 1)), "i long, kind string")


def _shops(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, fresh_path(spark, "warehouse"))
    session = engine.session()
    session.sql("CREATE TABLE shops (id INT PRIMARY KEY, segment VARCHAR(10), location POINT) USING HEAP; CREATE INDEX ON shops (location) USING RTREE")
    session.insert_rows("shops", located(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_mktsegment", "location").toDF("id", "segment", "location"))
    return engine


def rtree(name: str, statement: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shops(spark, sf_dir).session().one(statement).df


_lima, _shop = "POINT(-77.0428, -12.0464)", f"SELECT c_custkey::INT AS id FROM {CUSTOMERS}"
rtree("rtree_radius", f"SELECT id FROM shops WHERE distancia(location, {_lima}) <= 20", f"{_shop} WHERE {_plane('x', 'y', LX, LY)} <= 20")
rtree("rtree_radius_geodesic", f"SELECT id FROM shops WHERE distancia_geodesica(location, {_lima}) < 3000000", f"{_shop} WHERE {_sphere('x', 'y', LX, LY)} < 3000000")
rtree("rtree_knn", f"SELECT id FROM shops ORDER BY distancia_geodesica(location, {_lima}) LIMIT 10", f"{_shop} ORDER BY {_sphere('x', 'y', LX, LY)}, 1 LIMIT 10")
rtree("rtree_polygon", f"SELECT id FROM shops WHERE {_polygon(CORNER)} AND segment = 'BUILDING'", f"{_shop} WHERE {_inside(CORNER)} AND c_mktsegment = 'BUILDING'")
rtree("point_equality", "SELECT id FROM shops WHERE location = POINT(-172.081, 14.729)", f"{_shop} WHERE x = -172.081::DOUBLE AND y = 14.729::DOUBLE")

# --- constraints
@query("pk_duplicates", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("unique_violations", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicates(table(spark, sf_dir, "customer"), "c_nationkey")


@query("not_null_violations", "SELECT doc_id FROM documents WHERE lang IS NULL")
def _not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.nulls(table(spark, sf_dir, "documents"), "lang").select("doc_id")


@query("check_violations", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 300000)")
def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.failing(table(spark, sf_dir, "orders"), "o_totalprice < 300000").select("o_orderkey")


# --- text
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = f"SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '([.,;:¡!¿?])', ' \\1 ', 'g'), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN ({_STOP}))) AS term FROM documents"
_BAG = f"(SELECT doc_id, term, count(*) AS tf FROM ({_WORDS}) GROUP BY 1, 2)"
_HAS = f"(SELECT DISTINCT doc_id FROM {_BAG} WHERE term = '%s')"
A, B, D = "asbo", "cióndo", "ciónción"


_indexes: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, written once for each application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        _indexes[at] = Index.build(table(spark, sf_dir, "documents"), "doc_id", "text").write(fresh_path(spark, "index"))
    return _indexes[at]


@query("text_tokens", f"SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS m FROM ({_WORDS}) GROUP BY 1) USING (doc_id)")
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("m"))


@query("text_bow", f"SELECT doc_id, term, tf FROM {_BAG}")
def _bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("text_bow_map", f"SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS words FROM {_BAG} GROUP BY 1")
def _bow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = as_maps(bag(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return maps.select("doc_id", F.size("bag_of_words").cast("long").alias("terms"), F.aggregate(F.map_values("bag_of_words"), F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))


@query("text_df", f"SELECT term, count(*) AS df FROM {_BAG} GROUP BY 1")
def _df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).frequencies()


@query("text_postings", f"SELECT doc_id, tf FROM {_BAG} WHERE term = '{A}'")
def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).list(A)


def _boolean(name: str, words: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _index(spark, sf_dir).boolean(words)


_EVERY = f"SELECT DISTINCT doc_id FROM {_BAG}"
_in = lambda w: f"doc_id IN {_HAS % w}"
_boolean("text_and", f"{A} AND {B}", f"{_EVERY} WHERE {_in(A)} AND {_in(B)}")
_boolean("text_or", f"{A} OR {D}", f"{_EVERY} WHERE {_in(A)} OR {_in(D)}")
_boolean("text_and_not", f"{A} AND-NOT {B}", f"{_EVERY} WHERE {_in(A)} AND NOT {_in(B)}")
_boolean("text_or_not", f"{A} OR NOT {B}", f"{_EVERY} WHERE {_in(A)} OR NOT {_in(B)}")
_boolean("text_not", f"NOT {A} AND {B} OR {D}", f"{_EVERY} WHERE (NOT {_in(A)} AND {_in(B)}) OR {_in(D)}")


@query("text_and_tf", f"SELECT a.doc_id, (a.tf + b.tf)::BIGINT AS tf FROM {_BAG} a JOIN {_BAG} b ON a.doc_id = b.doc_id AND a.term = '{A}' AND b.term = '{B}'")
def _and_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return i.both(i.list(A), i.list(B))


@query("text_or_tf", f"SELECT doc_id, sum(tf)::BIGINT AS tf FROM {_BAG} WHERE term IN ('{A}', '{B}') GROUP BY 1")
def _or_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return i.either(i.list(A), i.list(B))


@query("text_without", f"SELECT doc_id, tf FROM {_BAG} WHERE term = '{A}' AND doc_id NOT IN (SELECT doc_id FROM {_BAG} WHERE term = '{B}')")
def _without(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return i.without(i.list(A), i.list(B))


@query("text_show", f"SELECT doc_id, left('{{' || string_agg('\"' || term || '\":' || tf, ',' ORDER BY term) || '}}', 80) AS bag_of_words FROM {_BAG} WHERE doc_id IN (3, 5, 8) GROUP BY 1")
def _show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_index(spark, sf_dir).postings, "doc_id", [3, 5, 8])


#: Published stems of Spanish words (fixed values).
STEMS = {"corriendo": "corr", "canciones": "cancion", "rápidamente": "rapid", "niñas": "niñ", "organización": "organiz", "hablaríamos": "habl", "biología": "biolog", "haciéndola": "hac", "chicharrones": "chicharron", "tortura": "tortur", "perros": "perr"}


@query("text_stems", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}', 1)" for i, v in enumerate(STEMS.values())) + ") v(id, term, tf)")
def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame(list(enumerate(STEMS)), "id int, word string")
    return bag(words, "id", "word", stems=True).withColumn("tf", F.col("tf").cast("int"))


@query("text_stemmed_search", "SELECT * FROM (VALUES (1), (2), (4)) v(id)")
def _stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["los perros corrieron", "un perro corría", "gatos", "corriendo con perras y perros"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id int, t string")
    return Index.build(docs, "id", "t", stems=True).boolean("perros AND correr")


_SCORES = f"""WITH b AS {_BAG}, f AS (SELECT term, count(*) AS df FROM b GROUP BY 1),
w AS (SELECT doc_id, term, (1 + log10(tf)) / (df + 1) AS w FROM b JOIN f USING (term)),
q AS (SELECT term, (1 + log10(n)) / (df + 1) AS q FROM (VALUES ('{A}', 2), ('{B}', 1), ('{D}', 1)) v(term, n) JOIN f USING (term)),
d AS (SELECT doc_id, sqrt(sum(w * w)) AS nd, sum(w * q) AS dot FROM w LEFT JOIN q USING (term) GROUP BY 1),
s AS (SELECT doc_id, dot / (nd * (SELECT sqrt(sum(q * q)) FROM q)) AS score FROM d)"""


@query("text_cosine_topk", f"{_SCORES} SELECT doc_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL ORDER BY round(score, 9) DESC, doc_id LIMIT 5")
def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).cosine(f"{A} {B} {A} {D}").withColumn("score", F.round("score", 6))


@query("text_cosine_linear", f"{_SCORES} SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM s")
def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).cosine(f"{A} {B} {A} {D}", None, True).withColumn("score", F.round("score", 6))


# --- catalogue and plans
_TWO = _btree + "; " + _hash


def _catalogue(name: str, oracle: str) -> None:
    @steps(name, oracle, indexes=_TWO)
    def run(engine: Engine, session) -> DataFrame:
        return session.one(f"SELECT * FROM {name}").df


_catalogue("sys_tables", "SELECT 0 AS table_id, 'sales' AS table_name, 'HEAP' AS organisation, 'id' AS primary_key")
_catalogue("sys_columns", "SELECT * FROM (VALUES (0, 'id', 'int', 0, true), (0, 'customer', 'int', 1, false), (0, 'status', 'varchar(1)', 2, false), (0, 'priority', 'varchar(15)', 3, false)) v(table_id, column_name, type, column_order, is_primary_key)")
_catalogue("sys_indexes", "SELECT * FROM (VALUES ('idx_sales_customer_unclustered', 'sales', 'customer', 'BTREE', false), ('idx_sales_priority_hash', 'sales', 'priority', 'HASH', false)) v(index_name, table_name, column_name, kind, clustered)")


def _plan(name: str, statement: str, oracle: str) -> None:
    """Labels and notes of a plan; costs, times and what Spark plans differ from run to run."""

    @steps(name, oracle, indexes=_TWO)
    def run(engine: Engine, session) -> DataFrame:
        result = session.one(statement)
        rows = []
        for line in (r[0] for r in result.rows()):
            rows.append((len(rows), line.split("  (cost=")[0].strip().removeprefix("-> ").split(" Time: ")[0]))
            if line.startswith("Execution Time") or (line.startswith("Planning Time") and "ANALYZE" not in statement):
                break
        return engine.spark.createDataFrame([(*r, result.columns[0]) for r in rows], "line int, what string, heading string")


def _lines(*lines: str) -> str:
    values = ", ".join(f"({i}, '{x}', 'QUERY PLAN')" for i, x in enumerate(lines))
    return f"SELECT * FROM (VALUES {values}) v(line, what, heading)"


_plan("explain_plan", "EXPLAIN SELECT id FROM sales WHERE customer = 1 ORDER BY id LIMIT 3", _lines("Limit", "Top-N Sort", "Sort Key: id", "Index Scan using idx_sales_customer_unclustered on sales", "Filter: customer = 1", "Planning"))
_plan("explain_hash", "EXPLAIN SELECT id FROM sales WHERE priority = '2-HIGH'", _lines("Index Scan using idx_sales_priority_hash on sales", "Filter: priority = ''2-HIGH''", "Planning"))
_plan("explain_change", "EXPLAIN DELETE FROM sales WHERE status = 'F'", _lines("Delete on sales", "Seq Scan on sales", "Filter: status = ''F''", "Planning"))
_plan("explain_analyze", "EXPLAIN ANALYZE SELECT status, COUNT(*) FROM sales WHERE id > 3 GROUP BY status ORDER BY status", _lines("Sort", "Sort Key: status", "HashAggregate", "Group Key: status", "Seq Scan on sales", "Filter: id > 3", "Rows Removed by Filter: 3", "Planning", "Execution").replace("'Rows Removed by Filter: 3'", "'Rows Removed by Filter: ' || (SELECT count(*) FROM orders WHERE o_orderkey <= 3)"))


@steps("transactions", "SELECT * FROM (VALUES ('aborted', 3), ('committed', 3)) v(status, events)")
def _transactions(engine: Engine, session) -> DataFrame:
    session.sql("BEGIN TRANSACTION; DELETE FROM sales WHERE id = 1; ROLLBACK; BEGIN TRANSACTION; DELETE FROM sales WHERE id = 1; END TRANSACTION")
    return engine.transactions().select("status", "events")


@query("ast_dump", "SELECT * FROM (VALUES (0, 'Delete'), (1, 'table: ''t'''), (2, 'where:'), (3, 'Compare'), (4, 'left:'), (5, 'Name'), (6, 'column: ''id'''), (7, 'op: ''='''), (8, 'value: 1')) v(line, part)")
def _ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dump(parse("DELETE FROM t WHERE id = 1")[0]).splitlines()
    return spark.createDataFrame([(i, x.strip()) for i, x in enumerate(lines)], "line int, part string")


# --- what the checker of names and types says, as rows
def verdicts(name: str, *statements: tuple[str, str]) -> None:
    oracle = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(statements)) + ") v(i, kind)"

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known, out = tables(spark, sf_dir), []
        for i, (text, _) in enumerate(statements):
            try:
                planner.select(parse(text)[0], known)
                out.append((i, "none"))
            except SqlError as e:
                out.append((i, e.kind))
        return spark.createDataFrame(out, "i int, kind string")


verdicts("join_checks", ("SELECT o_orderkey FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey", "semantic"), ("SELECT * FROM customer_at JOIN supplier_at ON customer_at.location = supplier_at.location", "semantic"), ("SELECT * FROM nation JOIN region ON n_name = r_regionkey", "semantic"), ("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", "none"))
verdicts("aggregate_checks", ("SELECT n_name, COUNT(*) FROM nation", "semantic"), ("SELECT SUM(n_name) FROM nation", "semantic"), ("SELECT n_name, COUNT(*) FROM nation GROUP BY n_regionkey", "semantic"), ("SELECT MAX(n_name) FROM nation", "none"))
verdicts("strict_end", ("SELECT * FROM nation LIMIT 1 1", "syntactic"), ("SELECT * FROM nation;", "none"), ("SELECT * FROM nation WHERE n_name = 'x", "lexical"))


@query("output_names", "SELECT * FROM (VALUES (0, 'c_mktsegment'), (1, 'count(*)'), (2, 'max_agg(c_acctbal)'), (3, 'min_agg(c_name)')) v(place, name)")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = planner.select(parse("SELECT c_mktsegment, COUNT(*), MAX(c_acctbal), MIN(c_name) FROM customer GROUP BY c_mktsegment")[0], tables(spark, sf_dir))
    return spark.createDataFrame([(i, n) for i, n in enumerate(df.columns) if names[i] == n], "place int, name string")


_sql = "SELECT * FROM nation JOIN nation ON n_regionkey = n_nationkey"
dialect("self_join", _sql, "a_key a_name a_region b_key b_name b_region", "SELECT a.n_nationkey AS a_key, a.n_name AS a_name, a.n_regionkey AS a_region, b.n_nationkey AS b_key, b.n_name AS b_name, b.n_regionkey AS b_region FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey")
dialect("join_key_typing", "SELECT l_orderkey, n_name FROM lineitem JOIN nation ON l_quantity = n_nationkey WHERE l_linenumber = 1", "l_orderkey n_name", "SELECT l_orderkey, n_name FROM lineitem JOIN nation ON l_quantity = n_nationkey WHERE l_linenumber = 1")


@query("attached_source", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, fresh_path(spark, "warehouse"))
    engine.attach("orders", table(spark, sf_dir, "orders"), "o_orderkey")
    return engine.session().one("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000").df


# --- rectangles
_NATIONS = f"SELECT c_nationkey, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {CUSTOMERS} GROUP BY 1"
_AREA = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))"


@query("rectangles", f"WITH n AS ({_NATIONS}) SELECT a.c_nationkey AS a, b.c_nationkey AS b, round({_AREA}, 3) AS area, round({_AREA} - (a.x1 - a.x0) * (a.y1 - a.y0), 3) AS more, a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS meets, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS holds FROM n a JOIN n b ON b.c_nationkey = a.c_nationkey + 1")
def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = located(table(spark, sf_dir, "customer"), "c_custkey").groupBy("c_nationkey").agg(*spatial.rectangle(F.col("location")))
    a, b = n.toDF("a", "ax0", "ay0", "ax1", "ay1"), n.toDF("b", "bx0", "by0", "bx1", "by1")
    p, q = ([F.col(f"{k}{c}") for c in ("x0", "y0", "x1", "y1")] for k in "ab")
    area = F.round(spatial.area(*spatial.union(p, q)), 3).alias("area")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", area, F.round(spatial.enlargement(p, q), 3).alias("more"), spatial.intersects(p, q).alias("meets"), spatial.contains(p, q).alias("holds"))


@query("mindist", f"SELECT c_custkey, round(sqrt(pow(greatest(-40 - x, 0, x - 30), 2) + pow(greatest(-20 - y, 0, y - 45), 2)), 6) AS d FROM {CUSTOMERS}")
def _mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, box = located(table(spark, sf_dir, "customer"), "c_custkey"), [F.lit(float(v)) for v in (-40, -20, 30, 45)]
    return df.select("c_custkey", F.round(spatial.mindist(F.col("location"), box), 6).alias("d"))
