import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakemill.catalog import Router
from lakemill.engine import Engine
from lakemill.functions import dates, scalars
from lakemill.operators import relational as R
from lakemill.security import AFTER_AGGREGATE, AFTER_JOIN, PLAINTEXT, SecurityConfig, VisibilityError
from lakemill.sources import readers, sinks
from lakemill.streaming.events import event_counts, stream_events
from lakemill.types import published, schema_of, spark_type


def test_percentile_disc(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 1, 4, 2, 3)] + [(2, None), (2, 7)], "g int, v int")
    got = {r.g: r.p for r in R.percentile_disc(df, ["g"], "v", 0.3).collect()}
    assert got == {1: 2, 2: 7}
    with pytest.raises(ValueError):
        R.percentile_disc(df, ["g"], "v", 1.5)
    many = spark.range(30000).selectExpr("if(id % 10 = 0, null, id % 3) as g", "if(id % 7 = 0, null, pmod(xxhash64(id), 5000)) as v").unionAll(spark.sql("select 9L, null"))
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        want = {r.g: r.p for r in many.groupBy("g").agg(F.expr(f"cast(percentile_disc({p}) within group (order by v) as bigint) as p")).collect()}
        assert {r.g: r.p for r in R.percentile_disc(many, ["g"], "v", p).collect()} == want
        assert R.percentile_disc(many, [], "v", p).first().p == many.agg(F.expr(f"cast(percentile_disc({p}) within group (order by v) as bigint)")).first()[0]


def test_ranked(spark):
    df = spark.range(4000).selectExpr("id", "if(id % 4 = 0, 1, null) as g", "if(id % 11 = 0, null, pmod(xxhash64(id), 90)) as v")
    over = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first())
    want = df.select("id", F.row_number().over(over.orderBy(F.col("v").asc_nulls_first(), "id")).alias("a"), F.rank().over(over).alias("b"), F.percent_rank().over(over).alias("c"))
    got = R.ranked(df, ["g"], "v", ["id"]).select("id", "row_number", "rank", "percent_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert R.ranked(df.where("false"), ["g"], "v").count() == 0
    one = spark.createDataFrame([(1, None, 3), (1, 5, 4), (2, 7, 1)], "g int, v int, o int")
    assert {(r.g, r["first"]) for r in R.first_row(one, ["g"], "v", "o").collect()} == {(1, None), (2, 7)}


def test_shuffled_rows_are_permuted(spark):
    df = spark.range(2000)
    got = [r.id for r in R.shuffled(df, 7).collect()]
    assert sorted(got) == list(range(2000)) and sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 40


def test_joins_and_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,), (2,)], "j int")
    assert [r.k for r in R.semi(a, b, a.k == b.j).collect()] == [2]
    assert {r.k for r in R.anti(a, b, a.k == b.j).collect()} == {1, None}
    assert {(r.k, r.f) for r in R.exists_flag(a, b, "k", "j", "f").collect()} == {(1, False), (2, True), (None, False)}


@pytest.mark.parametrize("op, kind, want", [(">", "ALL", set()), (">", "ANY", {3}), ("<>", "ALL", set()), ("=", "ANY", {2}), ("<>", "ANY", {3}), ("<=", "ANY", {1, 2})])
def test_quantified(spark, op, kind, want):
    a = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "j int")
    got = {r.k for r in R.quantified(a, F.col("k"), op, kind, b, "j").collect()}
    assert got == (want | ({1} if (op, kind) == ("<>", "ANY") else set()))
    empty = b.where("false")
    n = R.quantified(a, F.col("k"), op, kind, empty, "j").count()
    assert n == (4 if kind == "ALL" else 0)


def test_windows_limit_union(spark):
    df = spark.createDataFrame([(1, 3), (1, None), (1, 5), (2, 1)], "g int, v int")
    ranks = df.select("g", "v", F.rank().over(R.window(["g"], ["v"])).alias("r"))
    assert {(r.g, r.v, r.r) for r in ranks.collect()} == {(1, None, 1), (1, 3, 2), (1, 5, 3), (2, 1, 1)}
    assert R.limit_offset(df.orderBy("g", "v"), 2, 3).count() == 1
    with pytest.raises(ValueError):
        R.limit_offset(df, 0)
    assert R.concat(df, df, distinct=True).count() == 4
    assert R.top_per_group(df, ["g"], [F.desc("v")], 1).count() == 2


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.truncate(F.lit(-1.29), 1).alias("t"),
        scalars.divide(F.lit(1), F.lit(0)).alias("d"),
        scalars.int_divide(F.lit(-7), F.lit(2)).alias("i"),
        scalars.modulo(F.lit(-7), F.lit(3)).alias("m"),
        scalars.substr(F.lit("abcdef"), -3).alias("s"),
        scalars.if_(F.lit(None).cast("int"), F.lit(1), F.lit(2)).alias("f"),
        F.round(scalars.geodist(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).alias("g"),
        dates.str_to_date(F.lit("03.02.2020"), "%d.%m.%Y").cast("string").alias("p"),
        dates.str_to_date(F.lit("x"), "%d.%m.%Y").alias("q"),
        dates.time_diff(F.lit("2020-01-01 10:00:00").cast("timestamp"), F.lit("2020-01-01 11:30:05").cast("timestamp")).alias("w"),
    ).first()
    assert tuple(row) == (-1.2, None, -3, -1, "def", 2, 20015.0, "2020-02-03 00:00:00", None, "-01:30:05")


def test_types_and_results(spark):
    assert spark_type("float").simpleString() == "double" and spark_type("DATETIME").simpleString() == "timestamp_ntz"
    with pytest.raises(ValueError):
        spark_type("blob")
    df = spark.sql("SELECT CAST(1 AS INT) AS a, TIMESTAMP_NTZ '2020-01-02 03:04:05.6' AS b, TIMESTAMP '1970-01-01 00:01:00' AS c, CAST(1.5 AS DECIMAL(4,2)) AS d")
    assert tuple(published(df).first()) == (1, "2020-01-02 03:04:05", 60, 1.5)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, None, 1.5)], "k int, s string, v double")
    path = str(tmp_path / "out.csv")
    sinks.dump_file(df, path, single=True)
    with open(path) as f:
        assert sorted(f.read().splitlines()) == sorted(['"k","s","v"', '1,"a ""b"", c",NULL', "2,NULL,1.5"])
    with pytest.raises(FileExistsError):
        sinks.dump_file(df, path, single=True)
    back = spark.read.option("escape", '"').options(header=True, nullValue="NULL").schema(schema_of({"k": "int", "s": "string", "v": "double"})).csv(path)
    assert {tuple(r) for r in back.collect()} == {(1, 'a "b", c', None), (2, None, 1.5)}


def test_outfile_and_insert(spark, tmp_path):
    engine = Engine(spark, least_group=1)
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string").createOrReplaceTempView("src")
    path = str(tmp_path / "f.txt")
    engine.sql(f"SELECT k, s INTO OUTFILE PARTY_CODE 'alice' '{path}' FIELDS TERMINATED BY '|' ENCLOSED BY '\"' LINES TERMINATED BY '\\n' FROM src WHERE k = 2")
    with open(path) as f:
        assert f.read() == '"k"|"s"\n"2"|"y"\n'
    with pytest.raises(ValueError):
        engine.sql("INSERT INTO nowhere SELECT k FROM src")
    with pytest.raises(KeyError):
        engine.sql("INSERT INTO nowhere (k) SELECT k FROM src")


def test_routes_and_kinds(spark):
    router = Router({"db.t": "one", "db.*": "two", "*": "three"})
    assert [router.route(n) for n in ("db.t", "db.u", "x.y")] == ["one", "two", "three"]
    with pytest.raises(ValueError):
        readers.read(spark, "nothing")


def test_visibility(spark, tmp_path):
    for name in ("mine", "theirs"):
        spark.createDataFrame([(1, 2.0)], f"{name}_id int, {name}_v double").write.parquet(str(tmp_path / name))
    rules = {("alice", "theirs", "theirs_id"): AFTER_JOIN, ("alice", "theirs", "theirs_v"): AFTER_AGGREGATE, ("bob", "mine", "mine_id"): PLAINTEXT}
    engine = Engine(spark, 1, SecurityConfig({"mine": "alice", "theirs": "bob"}, rules))
    for name in ("mine", "theirs"):
        engine.register(name, "parquet", path=str(tmp_path / name))
    ok = "SELECT theirs_id, SUM(theirs_v) AS s FROM mine JOIN theirs ON mine_id = theirs_id GROUP BY theirs_id"
    assert engine.sql(ok, party="alice").count() == 1
    for bad in ("SELECT theirs_v FROM theirs", "SELECT theirs_id FROM theirs", "SELECT theirs_v + 1 AS x FROM mine JOIN theirs ON mine_id = theirs_id"):
        with pytest.raises(VisibilityError):
            engine.sql(bad, party="alice")
    assert engine.sql("SELECT mine_id FROM mine", party="bob").count() == 1
    with pytest.raises(VisibilityError):
        engine.sql("SELECT mine_v FROM mine", party="bob")


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i:02d}:30:00", "a" if i % 2 else "b", 1.25) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream_events(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "ck"), str(tmp_path / "out"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    whole = {tuple(r) for r in event_counts(df).withColumn("start", F.col("start").cast("string")).collect()}
    got = {tuple(r) for r in closed.withColumn("start", F.col("start").cast("string")).collect()}
    assert got and got < whole


def test_jdbc(spark):
    url = "jdbc:derby:memory:lakemill_test;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).selectExpr("id as k", "id % 7 as g")
    df.write.format("jdbc").options(url=url, dbtable="t", **options).save()
    sinks.append_jdbc(df.where("k < 10"), url, "t", **options)
    back = readers.read_jdbc(spark, url, "t", key="K", bounds=(0, 100), parts=4, **options)
    assert back.count() == 110 and back.rdd.getNumPartitions() == 4
    plan = back.where("G = 3").select("K")._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(g,3)" in plan and "ReadSchema: struct<k:bigint>" in plan
