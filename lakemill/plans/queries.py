"""One registered query for each operation of the engine, with SQL for DuckDB that gives the same rows.

Most are texts of the engine's own dialect, so that they run through translation, Spark's analyser and optimiser;
the rest use the DataFrame operators. Sums of money go through decimals, to be exact in any order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.engine import Engine
from lakemill.functions import dates, scalars
from lakemill.operators import relational as R
from lakemill.sources import readers, sinks
from lakemill.streaming.events import event_counts
from lakemill.types import published

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _sql(name: str, query: str, oracle: str | None = None, least_group: int = 1, params: dict | None = None) -> None:
    """Registers a query by its text; without ``oracle`` the same text holds for DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        words = {t.lower() for t in query.replace("(", " ").replace(")", " ").replace(",", " ").split()}
        engine.register_folder(sf_dir, [t for t in TABLES if t in words])
        return engine.sql(query, params=params, least_group=least_group)

    run.__doc__ = query
    QUERIES[name], ORACLE[name] = run, oracle or query


def _frame(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- flagship ---------------------------------------------------------------------------------------------------
_FLAGSHIP = f"""SELECT n_name, COUNT(*) AS n_orders, {_money("o_totalprice")} AS total, ROUND(AVG(o_totalprice), 2) AS mean_price
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE o_orderdate >= '1995-01-01' GROUP BY n_name {{}} ORDER BY total DESC, n_name LIMIT 10"""
_sql("nation_revenue", _FLAGSHIP.format(""), _FLAGSHIP.format("HAVING COUNT(*) >= 4"), least_group=4)

# -- projections, filters, predicates -----------------------------------------------------------------------------
_sql("scan_project", "SELECT r_regionkey AS k, r_name AS name, 7 AS seven, 'x' AS letter FROM region")
_sql("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_quantity < 40 AND l_discount <> 0.05 AND l_tax <= 0.04 AND l_suppkey > 10 AND l_returnflag = 'R'")
_sql(
    "filter_logical_xor",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 XOR l_discount > 0.05 AND l_tax > 0.02 || !(l_suppkey > 5)",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_quantity > 25) <> (l_discount > 0.05 AND l_tax > 0.02)) OR NOT (l_suppkey > 5)",
)
_sql("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
_sql("row_in", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (1, 2), (2, 9))")
_sql("between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-03-31' AND o_totalprice NOT BETWEEN 1000 AND 100000")
_sql(
    "like_regexp",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S\\_%' AND p_brand REGEXP '^Brand.*[1-3]$'",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S\\_%' ESCAPE '\\' AND regexp_matches(p_brand, '^Brand.*[1-3]$')",
)
_sql("is_null", "SELECT c_custkey, o_orderkey IS NULL AS no_order, -c_custkey AS negative, +c_nationkey AS same FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_orderkey IS NOT NULL AND c_acctbal < 0")
_sql("boolean_ops", "SELECT p_partkey, p_size > 10 AND p_retailprice > 1000 AS a, p_size > 10 OR p_retailprice > 1000 AS o, NOT p_size > 10 AS n FROM part")

# -- joins ----------------------------------------------------------------------------------------------------------
_sql("join_inner_multi", "SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
_sql("join_two_keys", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_sql("join_right", "SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey")
_sql("join_left_chain", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_comma", "SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey AND s_acctbal > 0")
_sql("join_theta_where", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
_sql("join_theta_on", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey > r_regionkey AND n_nationkey < 12")
_sql("join_three_group", "SELECT r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_HOLES = "(SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation) a"
_sql("join_null_keys", f"SELECT n_nationkey, r_name FROM {_HOLES} LEFT JOIN (SELECT NULLIF(r_regionkey, 2) AS j, r_name FROM region) b ON k = j")
_sql("not_in_nulls", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region WHERE r_regionkey > 0) AND n_nationkey > 0")
_sql("not_in_rows", f"SELECT n_nationkey FROM {_HOLES} WHERE k NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)")
_sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_sql("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_sql("exists_corr", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_sql("in_as_column", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_supplier FROM nation")


@_frame("join_bucketed", "SELECT l_orderkey, COUNT(*) AS n, MAX(o_totalprice) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def join_bucketed(spark, sf_dir):
    """Both sides dealt by the key once; join and group need no other shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = R.bucketed(_read(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", n)
    orders = R.bucketed(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", n)
    joined = lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("price"))


@_frame("frame_semi_anti", "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS rich FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < -900)")
def frame_semi_anti(spark, sf_dir):
    nation, supplier, customer = (_read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    out = R.semi(nation, customer, nation.n_nationkey == customer.c_nationkey)
    poor = supplier.where("s_acctbal < -900")
    out = R.anti(out, poor, out.n_nationkey == poor.s_nationkey)
    return R.exists_flag(out, supplier.where("s_acctbal > 0"), "n_nationkey", "s_nationkey", "rich").select("n_nationkey", "rich")


# -- aggregation ------------------------------------------------------------------------------------------------------
_sql(
    "agg_global",
    f"SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, {_money('l_extendedprice')} AS total, ROUND(AVG(l_quantity), 4) AS mean, MIN(l_shipdate) AS first, MAX(l_extendedprice) AS most, SUM(l_linenumber) AS lines FROM lineitem",
    f"SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, {_money('l_extendedprice')} AS total, ROUND(AVG(l_quantity), 4) AS mean, MIN(l_shipdate) AS first, MAX(l_extendedprice) AS most, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem",
)
_sql("agg_count_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem")
_sql("agg_group_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_GROUPED = f"SELECT o_custkey, COUNT(*) AS n, {_money('o_totalprice')} AS total, MIN(o_totalprice) AS least, MAX(o_orderdate) AS latest FROM orders GROUP BY o_custkey"
_sql("agg_group_threshold", _GROUPED, _GROUPED + " HAVING COUNT(*) >= 4", least_group=4)
_sql("agg_group_nothreshold", _GROUPED)
_sql("agg_group_exprs", "SELECT YEAR(o_orderdate) AS y, o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY y, 2", "SELECT YEAR(o_orderdate) AS y, o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY 1, 2")
_sql("agg_having", "SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 1000 AND MIN(l_discount) < 0.01")
_sql("agg_percentile_disc", "SELECT CAST(percentile_disc(0.3) WITHIN GROUP (ORDER BY l_linenumber) AS INT) AS p30, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50 FROM lineitem")
_sql("agg_group_percentile_disc", "SELECT l_returnflag, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p90 FROM lineitem GROUP BY l_returnflag")
_sql(
    "agg_tier_s",
    "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS names, MEDIAN(n_nationkey) AS mid, ROUND(STDDEV_POP(n_nationkey), 6) AS dev FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, CAST(MEDIAN(n_nationkey) AS DOUBLE) AS mid, ROUND(STDDEV_POP(n_nationkey), 6) AS dev FROM nation GROUP BY n_regionkey",
)
_sql("agg_sum_distinct", "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
_sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@_frame("agg_first_of_group", "SELECT n_regionkey, MIN(n_nationkey) AS first_key, arg_min(n_name, n_nationkey) AS first_name, CAST(COUNT(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey HAVING COUNT(*) >= 4")
def agg_first_of_group(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    return R.group_agg(nation, ["n_regionkey"], [F.min("n_nationkey").alias("first_key"), F.min_by("n_name", "n_nationkey").alias("first_name"), F.count("*").alias("n")], 4)


@_frame("frame_percentile_disc", "SELECT c_mktsegment, percentile_disc(0.25) WITHIN GROUP (ORDER BY c_custkey) AS p FROM customer GROUP BY c_mktsegment")
def frame_percentile_disc(spark, sf_dir):
    return R.percentile_disc(_read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 0.25)


@_frame("frame_percentile_price", "SELECT l_returnflag, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag")
def frame_percentile_price(spark, sf_dir):
    """Three groups with as many values as rows: a sketch brackets the value, so no task holds a group."""
    return R.percentile_disc(_read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@_frame("frame_ranks", "SELECT c_custkey, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS pr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def frame_ranks(spark, sf_dir):
    """Ranks in groups that may be large: rows are numbered in ranges of the order, not in one task for each group."""
    out = R.ranked(_read(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"])
    return out.select("c_custkey", F.col("row_number").cast("bigint").alias("rn"), F.col("rank").cast("bigint").alias("r"), F.round("percent_rank", 9).alias("pr"))


# -- windows ----------------------------------------------------------------------------------------------------------
_sql("win_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
_sql("win_rank", "SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem")
_sql("win_percent_rank", "SELECT c_custkey, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS pr FROM customer")
_sql(
    "win_dense_ntile_lead_lag",
    "SELECT c_custkey, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, NTILE(4) OVER w AS quarter, COALESCE(LEAD(c_custkey) OVER w, -1) AS next_key, LAG(c_custkey, 2, 0) OVER w AS before, ROUND(CUME_DIST() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)",
    "SELECT c_custkey, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, CAST(NTILE(4) OVER w AS INT) AS quarter, COALESCE(LEAD(c_custkey) OVER w, -1) AS next_key, LAG(c_custkey, 2, 0) OVER w AS before, ROUND(CUME_DIST() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)",
)
_RUNNING = "SELECT o_orderkey, {0} OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM orders"
_sql("win_running_sum", _RUNNING.format("SUM(CAST(o_totalprice AS DECIMAL(18,2)))").replace(" AS run", " AS d").join(["SELECT o_orderkey, CAST(d AS DOUBLE) AS run, near FROM (", ") t"]))
_sql(
    "win_range_frame",
    "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 10 FOLLOWING) AS near, COUNT(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM customer",
)
_sql("win_running_avg", "SELECT n_nationkey, ROUND(AVG(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS mean, FIRST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first FROM nation")
_sql("win_oblivious", "SELECT n_nationkey, MAX(n_nationkey) OVER w AS hi, MIN(n_nationkey) OVER w AS lo, COUNT(n_name) OVER w AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")


@_frame("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def top_per_group(spark, sf_dir):
    return R.top_per_group(_read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@_frame("group_mark", "SELECT n_nationkey, coalesce(LEAD(n_regionkey) OVER (ORDER BY n_regionkey, n_nationkey) <> n_regionkey, true) AS last FROM nation")
def group_mark(spark, sf_dir):
    """Marks each group's last row: the next key differs. Inside a group it is the row that nothing follows."""
    nation = _read(spark, sf_dir, "nation")
    return nation.select("n_nationkey", F.lead("n_nationkey").over(R.window(["n_regionkey"], ["n_nationkey"])).isNull().alias("last"))


# -- sort, limit, set operations ----------------------------------------------------------------------------------------
_sql("sort_multi", "SELECT c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey")
_sql("sort_nulls", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 ORDER BY o_orderkey, c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 ORDER BY o_orderkey NULLS FIRST, c_custkey")
_sql("sort_hidden", "SELECT c_name FROM customer ORDER BY c_acctbal * 2 DESC, c_custkey")
_sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 30", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
_sql("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("union_mixed", "SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region UNION SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
_sql("union_in_join", "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) u JOIN nation ON k = n_nationkey GROUP BY k ORDER BY k")

# -- subqueries -----------------------------------------------------------------------------------------------------------
_sql("derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 12")
_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) AND o_custkey < (SELECT MAX(c_custkey) FROM customer WHERE c_nationkey = 3)")
_sql("scalar_correlated", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT AVG(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey)")
_sql("any_all", "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 3) OR p_size < ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
_sql("all_of_none", "SELECT n_name FROM nation WHERE n_nationkey > ALL (SELECT c_nationkey FROM customer WHERE c_acctbal > 1e9) AND NOT n_nationkey >= ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 1e9)")
_sql(
    "eq_any_ne_all",
    "SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey <> ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey <> ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
_sql("having_any", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 10)")


@_frame("frame_quantified", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 5) OR s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 4)")
def frame_quantified(spark, sf_dir):
    s, c = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "customer")
    above = R.quantified(s, F.col("s_acctbal"), ">=", "ALL", c.where("c_nationkey = 5"), "c_acctbal")
    below = R.quantified(s, F.col("s_acctbal"), "<", "ANY", c.where("c_custkey < 4"), "c_acctbal")
    return above.select("s_suppkey").union(below.select("s_suppkey")).distinct()


# -- scalar functions -----------------------------------------------------------------------------------------------------
_sql(
    "math_basic",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_tax AS minus, l_quantity * l_discount AS times, l_quantity / l_discount AS quotient, ABS(-l_quantity) AS a, CEIL(l_extendedprice) AS c, FLOOR(l_extendedprice) AS f, SIGN(l_tax - 0.02) AS s, POW(l_linenumber, 2) AS p FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_tax AS minus, l_quantity * l_discount AS times, l_quantity / NULLIF(l_discount, 0) AS quotient, ABS(-l_quantity) AS a, CAST(CEIL(l_extendedprice) AS BIGINT) AS c, CAST(FLOOR(l_extendedprice) AS BIGINT) AS f, CAST(SIGN(l_tax - 0.02) AS DOUBLE) AS s, CAST(POW(l_linenumber, 2) AS DOUBLE) AS p FROM lineitem",
)
_sql(
    "math_round_trunc",
    "SELECT o_orderkey, ROUND(o_totalprice) AS r0, ROUND(o_totalprice, 1) AS r1, TRUNCATE(o_totalprice, 1) AS t1, TRUNCATE(-o_totalprice, 0) AS t0, TRUNCATE(o_totalprice, 2) AS t2, TRUNCATE(-o_totalprice, -3) AS k FROM orders",
    "SELECT o_orderkey, ROUND(o_totalprice) AS r0, ROUND(o_totalprice, 1) AS r1, CAST(trunc(CAST(o_totalprice AS DECIMAL(18, 2)) * 10) / 10 AS DOUBLE) AS t1, CEIL(-o_totalprice) AS t0, o_totalprice AS t2, CAST(-(CAST(trunc(o_totalprice) AS BIGINT) // 1000) * 1000 AS DOUBLE) AS k FROM orders",
)
_TRIG = "SELECT p_partkey, ROUND(SIN(x), 9) AS s, ROUND(COS(x), 9) AS c, ROUND(TAN(x), 6) AS t, ROUND(ASIN(y), 9) AS asn, ROUND(ACOS(y), 9) AS acs, ROUND(ATAN(x), 9) AS atn, ROUND({0}(x, y), 9) AS at2, ROUND(COT(x), 6) AS ct, ROUND(RADIANS(x), 9) AS rad, ROUND(DEGREES(y), 9) AS deg, ROUND(PI(), 9) AS pi FROM (SELECT p_partkey, p_size * 0.1 AS x, 1.0 / (p_size + 1) AS y FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part) p) q"
_sql("math_trig", _TRIG.format("ATAN"), _TRIG.format("ATAN2"))
_sql(
    "math_log_exp",
    "SELECT p_partkey, ROUND(LN(p_retailprice), 9) AS ln, ROUND(LOG10(p_retailprice), 9) AS l10, ROUND(LOG2(p_retailprice), 9) AS l2, ROUND(LOG(p_retailprice), 9) AS l, ROUND(LOG(3, p_retailprice), 9) AS l3, ROUND(SQRT(p_retailprice), 9) AS sq, ROUND(EXP(p_size / 50), 9) AS e FROM part",
    "SELECT p_partkey, ROUND(LN(p_retailprice), 9) AS ln, ROUND(LOG10(p_retailprice), 9) AS l10, ROUND(LOG2(p_retailprice), 9) AS l2, ROUND(LN(p_retailprice), 9) AS l, ROUND(LN(p_retailprice) / LN(3), 9) AS l3, ROUND(SQRT(p_retailprice), 9) AS sq, ROUND(EXP(p_size / 50), 9) AS e FROM part",
)
_sql(
    "math_intdiv_mod",
    "SELECT o_orderkey, o_orderkey DIV 7 AS d, o_orderkey % 7 AS m, -o_orderkey DIV 7 AS nd, (-o_orderkey) MOD 7 AS nm, MOD(o_orderkey, 5) AS f, COALESCE(o_orderkey DIV (o_custkey - o_custkey), -1) AS z, COALESCE(o_orderkey / 0, -1) AS y FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, (-o_orderkey) // 7 AS nd, (-o_orderkey) % 7 AS nm, o_orderkey % 5 AS f, CAST(-1 AS BIGINT) AS z, CAST(-1 AS DOUBLE) AS y FROM orders",
)
_sql("greatest_least", "SELECT s_suppkey, GREATEST(s_suppkey, s_nationkey, 10) AS g, LEAST(s_suppkey, s_nationkey, 10) AS l FROM supplier", "SELECT s_suppkey, CAST(GREATEST(s_suppkey, s_nationkey, 10) AS BIGINT) AS g, CAST(LEAST(s_suppkey, s_nationkey, 10) AS BIGINT) AS l FROM supplier")
_GEO = "6371 * ACOS(LEAST(GREATEST(SIN(RADIANS({1})) * SIN(RADIANS({3})) + COS(RADIANS({1})) * COS(RADIANS({3})) * COS(RADIANS({0}) - RADIANS({2})), -1.0), 1.0))"
_sql(
    "geodist",
    "SELECT s_suppkey, ROUND(GEODIST(s_nationkey * 7, s_nationkey - 20, s_suppkey, 30), 3) AS km FROM supplier",
    f"SELECT s_suppkey, ROUND({_GEO.format('s_nationkey * 7', 's_nationkey - 20', 's_suppkey', '30')}, 3) AS km FROM supplier",
)
_sql("str_funcs", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS joined, LOWER(c_name) AS low, UPPER(c_mktsegment) AS up, TRIM(CONCAT('  ', c_name, ' ')) AS trimmed FROM customer")
_sql(
    "str_substr",
    "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTRING(p_name, 4) AS b, SUBSTR(p_name, -3) AS c, SUBSTR(p_name, 0, 2) AS z FROM part",
    "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTRING(p_name, 4) AS b, SUBSTR(p_name, -3) AS c, '' AS z FROM part",
)
_sql(
    "str_len_replace_instr",
    "SELECT p_partkey, LENGTH(p_name) AS n, REPLACE(p_brand, 'Brand', 'B') AS r, INSTR(p_type, 'A') AS i FROM part",
    "SELECT p_partkey, CAST(strlen(p_name) AS INT) AS n, REPLACE(p_brand, 'Brand', 'B') AS r, CAST(INSTR(p_type, 'A') AS INT) AS i FROM part",
)


def _crc_table() -> str:
    """The table of CRC-32 over half bytes."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return str(out)


_CRC = f"""WITH halves AS (SELECT c_custkey, list_transform(string_split(hex(encode(c_name)), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS h FROM customer),
swapped AS (SELECT c_custkey, list_transform(range(1, len(h) + 1), lambda i: h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) AS h FROM halves)
SELECT c_custkey, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), h), lambda a, b: xor(a >> 4, {_crc_table()}[xor(a, b) % 16 + 1])), 4294967295) AS BIGINT) AS crc,
  printf('%X', c_custkey) AS hex, printf('%o', c_custkey) AS oct FROM swapped"""
_sql("hash_funcs", "SELECT c_custkey, CRC32(c_name) AS crc, CONV(c_custkey, 10, 16) AS hex, CONV(c_custkey, 10, 8) AS oct FROM customer", _CRC)
_sql(
    "now_and_rand",
    "SELECT n_nationkey, NOW() >= '2024-01-01' AND DATEDIFF(NOW(), CURDATE()) BETWEEN -1 AND 1 AS today, LENGTH(CURTIME()) AS clock, RAND() >= 0 AND RAND() < 1 AS unit FROM nation",
    "SELECT n_nationkey, TRUE AS today, CAST(8 AS INT) AS clock, TRUE AS unit FROM nation",
)
_sql(
    "date_add_sub",
    "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS m, ADDDATE(o_orderdate, 10) AS d, DATE_SUB(o_orderdate, INTERVAL 90 MINUTE) AS h, SUBDATE(o_orderdate, INTERVAL 1 YEAR) AS y FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate - INTERVAL 90 MINUTE AS h, o_orderdate - INTERVAL 1 YEAR AS y FROM orders",
)
_sql(
    "date_diff_lastday",
    "SELECT o_orderkey, DATEDIFF(o_orderdate, '1992-01-01') AS days, CAST(LAST_DAY(o_orderdate) AS CHAR) AS last FROM orders",
    "SELECT o_orderkey, CAST(DATEDIFF('day', TIMESTAMP '1992-01-01', o_orderdate) AS INT) AS days, CAST(LAST_DAY(o_orderdate) AS VARCHAR) AS last FROM orders",
)
_sql(
    "date_format_parse",
    "SELECT event_id, DATE_FORMAT(ts, '%Y/%m/%d %H:%i:%s') AS shown, STR_TO_DATE(DATE_FORMAT(ts, '%d.%m.%Y'), '%d.%m.%Y') AS day, STR_TO_DATE(event_type, '%Y') AS none FROM events",
    "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS shown, date_trunc('day', ts)::TIMESTAMP AS day, CAST(NULL AS TIMESTAMP) AS none FROM events",
)
_sql(
    "time_arithmetic",
    "SELECT o_orderkey, ADDTIME(o_orderdate, '01:30:10') AS later, SUBTIME(o_orderdate, '00:00:05') AS sooner, TIMEDIFF(ADDTIME(o_orderdate, '26:10:00'), o_orderdate) AS gap FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL '01:30:10' AS later, o_orderdate - INTERVAL 5 SECOND AS sooner, '26:10:00' AS gap FROM orders",
)
_sql(
    "datetime_numbers",
    "SELECT o_orderkey, o_orderdate + 90 AS later, o_orderdate - o_orderkey * 2 AS sooner, o_orderdate - CAST('1992-01-01' AS DATETIME) AS seconds FROM orders",
    "SELECT o_orderkey, o_orderdate + to_seconds(90) AS later, o_orderdate - to_seconds(o_orderkey * 2) AS sooner, date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS seconds FROM orders",
)
_sql(
    "wide_integers",
    "SELECT l_orderkey, l_linenumber, 2147483647 + l_linenumber AS a, l_linenumber * 1000000000 AS m FROM lineitem",
    "SELECT l_orderkey, l_linenumber, 2147483647::BIGINT + l_linenumber AS a, l_linenumber::BIGINT * 1000000000 AS m FROM lineitem",
)
_sql("is_true", "SELECT c_custkey, c_acctbal > 0 IS TRUE AS t, c_acctbal > 0 IS FALSE AS f, NULLIF(c_nationkey, 3) <=> NULLIF(c_nationkey, 4) AS same FROM customer", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS t, (c_acctbal > 0) IS FALSE AS f, NULLIF(c_nationkey, 3) IS NOT DISTINCT FROM NULLIF(c_nationkey, 4) AS same FROM customer")
_sql("if_case", "SELECT l_orderkey, l_linenumber, IF(l_quantity > 25, 'many', 'few') AS i, IF(l_linenumber - 1, 1, 0) AS nz, CASE WHEN l_discount = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS c, COALESCE(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END, 0) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, IF(l_quantity > 25, 'many', 'few') AS i, IF(l_linenumber <> 1, 1, 0) AS nz, CASE WHEN l_discount = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS c, COALESCE(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END, 0) AS s FROM lineitem")
_sql("ifnull_coalesce", "SELECT c_custkey, IFNULL(o_orderstatus, '-') AS s, COALESCE(o_orderkey, -c_custkey) AS k, COALESCE(NULLIF(c_nationkey, 3), -3) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
_sql(
    "cast_types",
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS SIGNED) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_linenumber AS CHAR) AS s, CAST('2020-02-03 04:05:06' AS DATETIME) AS t FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_linenumber AS VARCHAR) AS s, TIMESTAMP '2020-02-03 04:05:06' AS t FROM lineitem",
)


@_frame("frame_scalars", "SELECT s_suppkey, coalesce(s_acctbal / NULLIF(s_nationkey, 0), 0) AS q, coalesce(s_suppkey // NULLIF(s_nationkey, 0), -1) AS d, coalesce(s_suppkey % NULLIF(s_nationkey, 0), -1) AS m, (s_suppkey > 50) <> (s_nationkey > 10) AS x, substr(s_name, 3, 4) AS t, CASE WHEN s_nationkey <> 0 THEN 'y' ELSE 'n' END AS i FROM supplier")
def frame_scalars(spark, sf_dir):
    c = F.col
    return _read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.coalesce(scalars.divide(c("s_acctbal"), c("s_nationkey")), F.lit(0.0)).alias("q"),
        F.coalesce(scalars.int_divide(c("s_suppkey"), c("s_nationkey")), F.lit(-1)).alias("d"),
        F.coalesce(scalars.modulo(c("s_suppkey"), c("s_nationkey")), F.lit(-1)).alias("m"),
        scalars.xor(c("s_suppkey") > 50, c("s_nationkey") > 10).alias("x"),
        scalars.substr(c("s_name"), 3, 4).alias("t"),
        scalars.if_(c("s_nationkey"), F.lit("y"), F.lit("n")).alias("i"),
    )


@_frame("frame_dates", "SELECT event_id, ts + INTERVAL 3 DAY AS later, ts + to_seconds(event_id % 100) AS moved, strftime(ts, '%Y-%m') AS month FROM events")
def frame_dates(spark, sf_dir):
    ts = F.col("ts")
    return _read(spark, sf_dir, "events").select(
        "event_id", dates.add_interval(ts, 3, "DAY").alias("later"), dates.add_seconds(ts, F.col("event_id") % 100).alias("moved"), dates.date_format("ts", "%Y-%m").alias("month")
    )


# -- statements, sources, sinks, streaming ----------------------------------------------------------------------------------
@_frame("view_query", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def view_query(spark, sf_dir):
    engine = Engine(spark, least_group=1)
    engine.register_folder(sf_dir, ["orders"])
    name = f"big_{uuid.uuid4().hex[:8]}"
    engine.sql(f"CREATE VIEW {name} AS SELECT o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
    return engine.sql(f"SELECT o_orderstatus, COUNT(*) AS n FROM {name} GROUP BY o_orderstatus")


@_frame("view_least_group", "SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey HAVING COUNT(*) >= 4")
def view_least_group(spark, sf_dir):
    """A view's groups count for the query's least group, whatever the view was made under."""
    engine = Engine(spark, least_group=1)
    engine.register_folder(sf_dir, ["customer"])
    name = f"groups_{uuid.uuid4().hex[:8]}"
    engine.sql(f"CREATE VIEW {name} (k, n) AS SELECT c_nationkey, COUNT(*) FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey")
    return engine.sql(f"SELECT k, n FROM {name}", least_group=4)


_sql(
    "global_least_group",
    "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY r_regionkey) AS mid, GROUP_CONCAT(r_name ORDER BY r_name) AS names FROM region WHERE r_regionkey < 3",
    "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY r_regionkey) AS mid, string_agg(r_name, ',' ORDER BY r_name) AS names FROM region WHERE r_regionkey < 3",
    least_group=4,
)


@_frame("outfile_columns", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def outfile_columns(spark, sf_dir):
    engine = Engine(spark, least_group=1)
    engine.register_folder(sf_dir, ["nation"])
    path = _folder(spark)
    engine.sql(f"SELECT n_nationkey, n_name, n_regionkey INTO OUTFILE PARTY_CODE 'alice' '{path}/' (n_nationkey, n_name) FIELDS TERMINATED BY ',' OPTIONALLY ENCLOSED BY '\"' LINES TERMINATED BY '\\n' FROM nation")
    return readers.read_csv(spark, path, {"n_nationkey": "int", "n_name": "string"}, header=False)


_sql(
    "params_query",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'",
    params={"least": 150000, "status": "F"},
)


def _folder(spark) -> str:
    """A new folder where driver and executors both can write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/roundtrip-{uuid.uuid4().hex}"


@_frame("publish", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def publish(spark, sf_dir):
    """Results in the form that callers see: date-times as text."""
    return published(_read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")))


@_frame("shuffle_rows", "SELECT n_nationkey, n_name FROM nation")
def shuffle_rows(spark, sf_dir):
    return R.shuffled(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 7)


@_frame("shape", "SELECT CAST(COUNT(*) AS BIGINT) AS row_count, 11 AS column_count FROM lineitem")
def shape(spark, sf_dir):
    return R.shape(_read(spark, sf_dir, "lineitem"))


@_frame("constant_broadcast", "SELECT r_regionkey, CAST(3 AS INT) AS three, 'c' AS letter, TRUE AS yes, CAST(1.5 AS DOUBLE) AS half FROM region")
def constant_broadcast(spark, sf_dir):
    """Scalars take the shape of the relation that they stand beside."""
    return _read(spark, sf_dir, "region").select("r_regionkey", F.lit(3).alias("three"), F.lit("c").alias("letter"), F.lit(True).alias("yes"), F.lit(1.5).alias("half"))


@_frame("csv_roundtrip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    path = _folder(spark)
    sinks.dump_file(_read(spark, sf_dir, "nation"), path)
    return readers.read_csv(spark, path, {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, header=False)


@_frame("insert_select", "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def insert_select(spark, sf_dir):
    path = _folder(spark)
    spark.createDataFrame([], "segment string, n bigint").write.parquet(path)
    engine = Engine(spark, least_group=1)
    engine.register_folder(sf_dir, ["customer"])
    engine.register("target", "parquet", sink=lambda df: sinks.append_parquet(df, path), path=path)
    engine.sql("INSERT INTO target (segment, n) SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment")
    return spark.read.parquet(path)


@_frame("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly counts by type. The same function runs over a stream (see ``streaming.events``)."""
    return event_counts(_read(spark, sf_dir, "events"))
