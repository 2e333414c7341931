"""Who may see what, least groups, routes and sources."""

import threading

import pytest

from lakemill.catalog import Router
from lakemill.engine import Engine
from lakemill.plans.queries import QUERIES
from lakemill.security import AFTER_AGGREGATE, AFTER_COMPARE, AFTER_JOIN, ENCRYPTED_ONLY, PLAINTEXT, SecurityConfig, VisibilityError
from lakemill.sources import readers, sinks
from lakemill.sql.tokens import SqlError
from lakemill.sql.translate import translate
from tests.test_queries import FOLDER


@pytest.fixture
def engine(spark, tmp_path):
    rules = {
        ("alice", "theirs", "k"): AFTER_JOIN, ("alice", "theirs", "v"): AFTER_AGGREGATE, ("alice", "theirs", "c"): AFTER_COMPARE,
        ("alice", "theirs", "e"): ENCRYPTED_ONLY, ("alice", "theirs", "p"): PLAINTEXT,
    }
    engine = Engine(spark, 1, SecurityConfig({"mine": "alice", "theirs": "bob"}, rules))
    spark.createDataFrame([(i, i * 2) for i in range(6)], "m int, n int").write.parquet(str(tmp_path / "mine"))
    spark.createDataFrame([(i, 1.5, 2, 3, "x") for i in range(6)], "k int, v double, c int, e int, p string").write.parquet(str(tmp_path / "theirs"))
    spark.createDataFrame([], "a double").write.parquet(str(tmp_path / "target"))
    for name in ("mine", "theirs"):
        engine.register(name, "parquet", path=str(tmp_path / name))
    target = str(tmp_path / "target")
    engine.register("target", "parquet", owner="alice", sink=lambda df: sinks.append_parquet(df, target), path=target)
    return engine


@pytest.mark.parametrize(
    "query",
    [
        "SELECT SUM(v) AS s FROM theirs",
        "SELECT p, AVG(v) AS s FROM theirs GROUP BY p",
        "SELECT n, p FROM mine JOIN theirs ON m = k",
        "SELECT k FROM mine JOIN theirs ON m = k",
        "SELECT c > 3 AS big FROM theirs",
        "SELECT p FROM theirs WHERE c > 3",
        "SELECT (SELECT MAX(v) FROM theirs) AS s, n FROM mine",
        "SELECT n, RANK() OVER (ORDER BY m) AS r FROM mine",
        "SELECT n FROM mine UNION ALL SELECT 1 AS one FROM theirs",
        "SELECT DISTINCT p FROM theirs ORDER BY p LIMIT 3",
        "SELECT p, SUM(v) AS s FROM theirs GROUP BY p HAVING SUM(v) > 1",
    ],
)
def test_allowed(engine, query):
    engine.sql(query, party="alice").collect()


@pytest.mark.parametrize(
    "query",
    [
        "SELECT v FROM theirs",
        "SELECT MAX(e) AS s FROM theirs",
        "SELECT MAX(v) OVER (PARTITION BY p) AS s FROM theirs",
        "SELECT RANK() OVER (ORDER BY e) AS s FROM theirs",
        "SELECT (SELECT MAX(e) FROM theirs) AS s FROM mine",
        "SELECT n + (SELECT MAX(e) FROM theirs) AS s FROM mine",
        "SELECT n FROM mine WHERE n > (SELECT MAX(e) FROM theirs)",
        "SELECT n FROM mine WHERE m IN (SELECT e FROM theirs)",
        "SELECT p FROM theirs WHERE e = 3",
        "SELECT p FROM theirs WHERE v > 1",
        "SELECT GROUP_CONCAT(v) AS s FROM theirs",
        "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS s FROM theirs",
        "SELECT DISTINCT v FROM theirs",
        "SELECT n FROM mine UNION ALL SELECT e FROM theirs",
        "SELECT q.x FROM (SELECT e AS x FROM theirs) q",
        "SELECT c FROM theirs",
        "SELECT p, SUM(v) AS s FROM theirs GROUP BY p HAVING MAX(e) > 1",
        "SELECT s.explode FROM (SELECT EXPLODE(ARRAY(e)) AS explode FROM theirs) s",
    ],
)
def test_forbidden(engine, query):
    with pytest.raises(VisibilityError):
        engine.sql(query, party="alice")


def test_views_and_unknown_tables_hide_nothing(engine, spark):
    engine.sql("CREATE VIEW shown AS SELECT e AS z, p FROM theirs")
    with pytest.raises(VisibilityError):
        engine.sql("SELECT z FROM shown", party="alice")
    assert engine.sql("SELECT p FROM shown", party="alice").count() == 6
    spark.createDataFrame([(1,)], "s int").createOrReplaceTempView("strange")
    with pytest.raises(VisibilityError):
        engine.sql("SELECT s FROM strange", party="alice")


def test_writes_are_checked(engine, spark, tmp_path):
    path = str(tmp_path / "f.txt")
    for query in (f"SELECT e INTO OUTFILE PARTY_CODE 'alice' '{path}' FROM theirs", f"SELECT e INTO OUTFILE '{path}' FROM theirs", f"SELECT e, p INTO OUTFILE PARTY_CODE 'bob' '{path}b', PARTY_CODE 'alice' '{path}' (e) FROM theirs"):
        with pytest.raises((VisibilityError, SqlError)):
            engine.sql(query)
    engine.sql(f"SELECT e, p INTO OUTFILE PARTY_CODE 'bob' '{path}b', PARTY_CODE 'alice' '{path}a/' (p) FROM theirs")
    assert {r.value for r in spark.read.text(path + "a").collect()} == {"x"}
    with open(path + "b") as f:
        assert f.readline() == "e,p\n"
    with pytest.raises(VisibilityError):
        engine.sql("INSERT INTO target (a) SELECT v FROM theirs")
    engine.sql("INSERT INTO target (a) SELECT SUM(v) FROM theirs")
    assert [r.a for r in spark.read.parquet(str(tmp_path / "target")).collect()] == [9.0]


def test_least_group_of_views_and_global_aggregates(spark):
    engine = Engine(spark)
    spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "g int, x int").createOrReplaceTempView("small")
    engine.sql("CREATE OR REPLACE VIEW sizes (g, n) AS SELECT g, COUNT(*) FROM small GROUP BY g")
    engine.sql("CREATE VIEW of_sizes AS SELECT n FROM sizes")
    assert engine.sql("SELECT * FROM of_sizes").count() == 0
    assert engine.sql("SELECT * FROM of_sizes", least_group=2).count() == 1
    assert engine.sql("SELECT * FROM sizes", least_group=1).count() == 2
    assert [tuple(r) for r in engine.sql("SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY x) AS m, GROUP_CONCAT(x ORDER BY x) AS l FROM small").collect()] == [(6, "5,6,7")]
    with pytest.raises(SqlError):
        engine.sql("CREATE VIEW wrong (a, b, c) AS SELECT g FROM small")
    assert Engine(spark, config=SecurityConfig(least_group=7)).least_group == 7


def test_truncate(spark):
    engine = Engine(spark)
    spark.createDataFrame([(0.29, 4.35, -4.35, 1e300)], "a double, b double, c double, d double").createOrReplaceTempView("cut")
    row = engine.sql("SELECT TRUNCATE(a, 2) AS a, TRUNCATE(b, 2) AS b, TRUNCATE(c, 2) AS c, TRUNCATE(c, 1) AS d, TRUNCATE(d, 2) AS e, TRUNCATE(199, -2) AS f FROM cut").first()
    assert tuple(row) == (0.29, 4.35, -4.35, -4.3, 1e300, 100.0)


def test_types(spark):
    types = {"s": "string", "d": "time", "i": "int32", "b": "number"}
    for bad in ("i + 'a'", "s * 2", "s < 3", "SUM(s)", "AVG(t.s)", "SIN(s)", "LOWER(i)", "s > 'm'", "d + d", "1 + CONCAT(s, 'x')"):
        with pytest.raises(SqlError):
            translate(f"SELECT {bad} AS x FROM t", 1, types)
    for good in ("d > '2020-01-01'", "s = 'a'", "s LIKE 'a%'", "MAX(s)", "i + b", "COUNT(s)", "-i", "b * 2 - 1"):
        translate(f"SELECT {good} AS x FROM t", 1, types)
    assert translate("SELECT d - 5 AS x FROM t", 1, types) == "SELECT CAST ((d - make_dt_interval (0, 0, 0, 5)) AS TIMESTAMP_NTZ) AS x FROM t"
    assert "timestampdiff (SECOND, e.d, t.d)" in translate("SELECT t.d - e.d AS x FROM t, e", 1, types)
    with pytest.raises(ValueError):
        translate("SELECT DATE_FORMAT(d, '%U') AS x FROM t", 1, types)


@pytest.mark.parametrize("name", ["anti_not_in", "eq_any_ne_all", "not_in_rows"])
def test_no_broadcast_of_unknown_size(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "LeftAnti" in plan


def test_not_in_with_nulls(spark):
    engine = Engine(spark, least_group=1)
    spark.createDataFrame([(1,), (2,), (None,)], "x int").createOrReplaceTempView("xs")
    for values, want in (([], [1, 2, None]), ([2], [1]), ([None], []), ([2, None], []), ([7], [1, 2])):
        spark.createDataFrame([(v,) for v in values], "y int").createOrReplaceTempView("ys")
        for form in ("x NOT IN (SELECT y FROM ys)", "x <> ALL (SELECT y FROM ys)", "NOT x IN (SELECT y FROM ys)"):
            got = [r.x for r in engine.sql(f"SELECT x FROM xs WHERE {form}").collect()]
            assert sorted(got, key=str) == sorted(want, key=str)


def test_router_serves_tables(spark, tmp_path):
    for db, n in (("a", 1), ("b", 2)):
        spark.range(n).selectExpr("id", "id + 1 as up").write.parquet(str(tmp_path / db))
    readers.READERS["folder"] = lambda spark, root, table: spark.read.parquet(f"{root}/{table[0]}")
    engine = Engine(spark, 1, router=Router({"first.a": "x", "*": "x"}), sources={"x": {"kind": "folder", "root": str(tmp_path)}})
    assert engine.sql("SELECT a.id, t.up FROM first.a JOIN other.b AS t ON first.a.id = t.id").collect() == [(0, 1)]
    assert engine.sql("SELECT COUNT(*) AS n FROM other.b").first().n == 2
    assert [engine.router.route(n) for n in ("first.a", "z.y")] == ["x", "x"]
    with pytest.raises(KeyError):
        Router({}).route("a.b")


def test_insert_into_a_database_is_atomic(spark):
    url = "jdbc:derby:memory:lakemill_atomic;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(3).selectExpr("cast(id as int) as k").write.format("jdbc").options(url=url, dbtable="numbers", **options).save()
    read = lambda: sorted(r[0] for r in readers.read_jdbc(spark, url, "numbers", **options).collect())
    sinks.append_jdbc(spark.range(10, 13).selectExpr("cast(id as int) as k"), url, "numbers", **options)
    assert read() == [0, 1, 2, 10, 11, 12]
    with pytest.raises(Exception):  # noqa: B017
        sinks.append_jdbc(spark.range(20, 24).selectExpr("if(id = 23, id + 3000000000, id) as k").repartition(4), url, "numbers", **options)
    assert read() == [0, 1, 2, 10, 11, 12]


def test_databases_by_kind():
    options = readers.jdbc_options("mysql", "db=shop;user=u;password=a=b;host=h")
    assert options == {"url": "jdbc:mysql://h:3306/shop", "driver": "com.mysql.cj.jdbc.Driver", "user": "u", "password": "a=b"}
    assert readers.jdbc_options("sqlite", "db=/x/y.db")["url"] == "jdbc:sqlite:/x/y.db"
    assert readers.jdbc_options("postgresql", "jdbc:postgresql://a/b")["url"] == "jdbc:postgresql://a/b"


def test_csv_paths_and_nulls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('k,s,v\n1,"a ""q"", b",NULL\n2,NULL,1.5\n')
    columns = {"k": "int", "s": "string", "v": "double"}
    df = readers.read_csv(spark, str(tmp_path / "in" / "a.csv"), columns, root=str(tmp_path / "in"))
    assert {tuple(r) for r in df.collect()} == {(1, 'a "q", b', None), (2, None, 1.5)}
    for path in ("/etc/passwd", f"{tmp_path}/in/../out.csv", f"{tmp_path}/inner/a.csv"):
        with pytest.raises(ValueError):
            readers.read_csv(spark, path, columns, root=str(tmp_path / "in"))


def test_flight_sql(spark):
    flight = pytest.importorskip("pyarrow.flight")
    import pyarrow as pa

    from lakemill.sources.flight import command

    table = pa.table({"k": pa.array([1, 2, 3], pa.int64()), "s": ["a", None, "c"]})

    class Server(flight.FlightServerBase):
        def get_flight_info(self, context, descriptor):
            assert descriptor.command == command("SELECT k, s FROM t")
            ends = [flight.FlightEndpoint(str(i).encode(), []) for i in range(3)]
            return flight.FlightInfo(table.schema, descriptor, ends, 3, -1)

        def do_get(self, context, ticket):
            return flight.RecordBatchStream(table.slice(int(ticket.ticket), 1))

    server = Server("grpc://127.0.0.1:0")
    threading.Thread(target=server.serve, daemon=True).start()
    df = readers.read(spark, "arrowsql", uri=f"grpc://127.0.0.1:{server.port}", query="SELECT k, s FROM t")
    assert {tuple(r) for r in df.collect()} == {(1, "a"), (2, None), (3, "c")} and df.rdd.getNumPartitions() == 3
    server.shutdown()
