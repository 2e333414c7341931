import pytest

from lakemill.engine import Engine
from lakemill.functions.dates import java_pattern
from lakemill.sql.tokens import SqlError
from lakemill.sql.translate import translate


@pytest.fixture(scope="module")
def engine(spark):
    spark.createDataFrame([(1, 2, "a"), (2, None, "b"), (None, 0, "c"), (4, 2, None)], "x int, y int, s string").createOrReplaceTempView("t")
    spark.createDataFrame([], "z int").createOrReplaceTempView("none")
    spark.createDataFrame([(1,), (None,)], "z int").createOrReplaceTempView("holes")
    return Engine(spark, least_group=1)


def rows(engine, sql, **how):
    return sorted((tuple(r) for r in engine.sql(sql, **how).collect()), key=str)


@pytest.mark.parametrize(
    "condition, xs",
    [
        ("x > ALL (SELECT z FROM none)", [None, 1, 2, 4]),
        ("x > ANY (SELECT z FROM none)", []),
        ("x >= ALL (SELECT z FROM holes)", []),
        ("x >= ANY (SELECT z FROM holes)", [1, 2, 4]),
        ("x <> ANY (SELECT x FROM t)", [1, 2, 4]),
        ("x = ALL (SELECT z FROM holes WHERE z IS NOT NULL)", [1]),
        ("x = ANY (SELECT y FROM t)", [2]),
        ("x <> ALL (SELECT z FROM holes)", []),
        ("x < ALL (SELECT DISTINCT y + 10 FROM t WHERE y > 0)", [1, 2, 4]),
        ("x > 1 XOR y = 2", [1, 2, None] if False else [1]),
    ],
)
def test_conditions(engine, condition, xs):
    if "XOR" in condition:
        # (x > 1) xor (y = 2): 1 -> false xor true; 2 -> null; null -> null; 4 -> true xor true
        assert rows(engine, f"SELECT x FROM t WHERE {condition}") == [(1,)]
    else:
        assert rows(engine, f"SELECT x FROM t WHERE {condition}") == sorted([(x,) for x in xs], key=str)


def test_division_by_zero_is_null(engine):
    assert rows(engine, "SELECT 7 / y AS a, 7 DIV y AS b, 7 % y AS c, 7 MOD y AS d FROM t WHERE x IS NULL") == [(None,) * 4]


def test_threshold(engine):
    assert rows(engine, "SELECT y, COUNT(*) AS n FROM t GROUP BY y", least_group=2) == [(2, 2)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM t", least_group=100) == [(4,)]
    assert rows(engine, "SELECT DISTINCT y FROM t WHERE y = 0", least_group=100) == [(0,)]
    assert rows(engine, "SELECT y, COUNT(*) AS n FROM t GROUP BY y HAVING y > 5 OR y < 5", least_group=2) == [(2, 2)]
    inner = "SELECT MAX(n) AS m FROM (SELECT y, COUNT(*) AS n FROM t GROUP BY y) q"
    assert rows(engine, inner, least_group=3) == [(None,)]


def test_strings_and_comments(engine):
    assert rows(engine, "SELECT CONCAT('a XOR b', \"-\", s) AS c /* note */ FROM t WHERE s = 'a' -- end") == [("a XOR b-a",)]


@pytest.mark.parametrize("sql", ["SELECT 1", "SELECT x FROM t LIMIT 0", "SELECT x FROM t NATURAL JOIN none", "DELETE FROM t", "SELECT x FROM t JOIN none USING (x)", "SELECT VAR_POP(x) AS v FROM t", "", "SELECT x <=> ANY (SELECT z FROM none) AS b FROM t"])
def test_rejected(engine, sql):
    with pytest.raises(SqlError):
        engine.sql(sql)


def test_patterns():
    assert java_pattern("%Y-%m-%d %H:%i:%s") == "yyyy-MM-dd HH:mm:ss"
    assert java_pattern("at %k o''clock, %% %W") == "'at 'H' o''''clock, % 'EEEE"


def test_translation_is_readable():
    assert translate("SELECT a FROM t LIMIT 3, 4") == "SELECT a FROM t LIMIT 4 OFFSET 3"
    assert "count (1) >= 4" in translate("SELECT a, COUNT(*) AS n FROM t GROUP BY a", 4)


def test_params_and_views(engine, spark):
    assert rows(engine, "SELECT x FROM t WHERE x > :low AND s = :s", params={"low": 1, "s": "b"}) == [(2,)]
    engine.sql("CREATE VIEW v AS SELECT x + 1 AS up FROM t")
    assert rows(engine, "SELECT MAX(up) AS m FROM v") == [(5,)]
    assert {r.col_name for r in engine.sql("DESCRIBE t").collect()} >= {"x", "y", "s"}
    assert engine.sql("SHOW TABLES").count() >= 3
    with pytest.raises(SqlError):
        engine.sql("EXPLAIN SELECT x FROM t")
