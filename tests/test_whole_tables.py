"""Queries that stand for an operation run it over whole tables."""

import pytest

from lakemill.plans.queries import QUERIES
from tests.test_queries import FOLDER, pytestmark  # noqa: F401

#: Ten times the rows, more than the filters that stood there let through.
LARGER = FOLDER.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name, table", [("math_basic", "lineitem"), ("math_round_trunc", "orders"), ("math_intdiv_mod", "orders"), ("time_arithmetic", "orders")])
def test_every_row(spark, name, table):
    assert QUERIES[name](spark, LARGER).count() == spark.read.parquet(f"{LARGER}/{table}.parquet").count()


def test_sort_and_union_are_not_cut(spark):
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").collect()
    want = sorted(((r.c_nationkey, r.c_acctbal, r.c_custkey) for r in customers), key=lambda r: (-r[0], r[1], r[2]))
    assert [tuple(r) for r in QUERIES["sort_multi"](spark, FOLDER).collect()] == want
    nations = {r.c_nationkey for r in customers} | {r.s_nationkey for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").collect()}
    assert [r.k for r in QUERIES["union_in_join"](spark, FOLDER).collect()] == sorted(nations)
