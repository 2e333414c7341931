"""Window frames that run to the group's end: the rows of SQL, and no frame that Spark adds up anew for each row."""

import pytest

from lakemill.engine import Engine
from lakemill.plans.queries import QUERIES
from lakemill.sql.translate import translate
from tests.test_queries import FOLDER, pytestmark  # noqa: F401

AGAIN = "currentrow$(), unboundedfollowing$()"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_range_frame_is_added_up_once(spark):
    df = QUERIES["win_range_frame"](spark, FOLDER)
    assert AGAIN not in plan(df) and "RangeFrame, -50" in plan(df)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    """Groups of a null key and of one row, null and equal keys, and one group that holds most rows."""
    path = str(tmp_path_factory.mktemp("frames") / "f")
    df = spark.range(600).selectExpr(
        "id",
        "CASE WHEN id = 7 THEN 9 WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN 2 ELSE 1 END AS g",
        "if(id % 13 = 0, NULL, pmod(xxhash64(id), 90) - 45) AS k",
        "if(id % 17 = 0, NULL, pmod(xxhash64(id, 1), 4)) AS j",
        "timestamp_ntz'2024-01-01' + make_dt_interval(pmod(xxhash64(id), 40)) AS d",
        "if(id % 3 = 0, NULL, id) AS v",
    )
    df.write.parquet(path)
    made = Engine(spark, least_group=1)
    made.register("f", "parquet", path=path)
    return made


@pytest.mark.parametrize(
    "window",
    [
        "PARTITION BY g ORDER BY k RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING",
        "PARTITION BY g ORDER BY k RANGE BETWEEN 5 PRECEDING AND UNBOUNDED FOLLOWING",
        "PARTITION BY g ORDER BY k DESC RANGE BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING",
        "PARTITION BY g ORDER BY k ASC NULLS LAST RANGE BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING",
        "PARTITION BY g, j ORDER BY k DESC NULLS FIRST RANGE BETWEEN 5 PRECEDING AND UNBOUNDED FOLLOWING",
        "PARTITION BY g ORDER BY j, k DESC, COALESCE(v, 0) NULLS LAST RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING",
        "ORDER BY d RANGE BETWEEN INTERVAL '2' DAY PRECEDING AND UNBOUNDED FOLLOWING",
    ],
)
def test_frames_to_the_end(spark, engine, window):
    query = f"SELECT id, COUNT(*) OVER ({window}) AS n, COUNT(v) OVER w AS c, SUM(v) OVER (w) AS s, MIN(v) OVER w AS lo, MAX(v) OVER w AS hi, AVG(v) OVER w AS mean FROM f WINDOW w AS ({window})"
    got, want = engine.sql(query), spark.sql(query)
    assert "unboundedfollowing$()" in plan(want) and "unboundedfollowing$()" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_frames_that_stay():
    for frame in ("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING"):
        assert translate(f"SELECT COUNT(*) OVER (ORDER BY k {frame}) AS n FROM f").endswith(f"OVER (ORDER BY k {frame}) AS n FROM f")
    frame = "ORDER BY k RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    assert f"OVER ({frame})" in translate(f"SELECT LAST_VALUE(v) OVER ({frame}) AS l FROM f")
    # a subquery's window has its own meaning, whatever the outer query calls by its name
    inner = "SELECT MAX(v) OVER w AS m FROM f WINDOW w AS (ORDER BY k)"
    assert inner.replace("MAX(", "MAX (") in translate(f"SELECT COUNT(*) OVER w AS n FROM ({inner}) q WINDOW w AS ({frame.replace('k', 'm')})")
