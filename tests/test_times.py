"""Amounts of time that are no time of day."""

import pytest

from lakemill.engine import Engine

MOMENT = "CAST('2020-03-01 12:00:00' AS DATETIME)"


@pytest.mark.parametrize(
    "amount, later, sooner",
    [
        ("01:30:10", "2020-03-01 13:30:10", "2020-03-01 10:29:50"),
        ("26:10:00", "2020-03-02 14:10:00", "2020-02-29 09:50:00"),
        ("-01:30:00", "2020-03-01 10:30:00", "2020-03-01 13:30:00"),
        ("-100:00:01", "2020-02-26 07:59:59", "2020-03-05 16:00:01"),
        ("0:00:00.5", "2020-03-01 12:00:00.500000", "2020-03-01 11:59:59.500000"),
        ("838:59", "2020-04-05 10:59:00", "2020-01-26 13:01:00"),
        ("05", "2020-03-01 17:00:00", "2020-03-01 07:00:00"),
    ],
)
def test_amounts(spark, amount, later, sooner):
    spark.createDataFrame([(amount,), (None,)], "a string").createOrReplaceTempView("amounts")
    engine = Engine(spark, least_group=1)
    for a in ("a", f"'{amount}'"):
        rows = engine.sql(f"SELECT CAST(ADDTIME({MOMENT}, {a}) AS CHAR) AS x, CAST(SUBTIME({MOMENT}, {a}) AS CHAR) AS y FROM amounts WHERE a IS NOT NULL").collect()
        assert [(r.x.rstrip("0") if "." in r.x else r.x, r.y.rstrip("0") if "." in r.y else r.y) for r in rows] == [tuple(t.rstrip("0") if "." in t else t for t in (later, sooner))]
    assert engine.sql(f"SELECT ADDTIME({MOMENT}, a) AS x FROM amounts WHERE a IS NULL").collect()[0].x is None
    gap = engine.sql(f"SELECT TIMEDIFF(ADDTIME({MOMENT}, a), {MOMENT}) AS gap FROM amounts WHERE a = '26:10:00'").collect()
    assert [r.gap for r in gap] == (["26:10:00"] if amount == "26:10:00" else [])
