"""Connected components of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.blocks import cleaning, discard, written
from lakemill.llm.skew import keyed_join

#: Below so many edges no id can have enough of them to matter.
FEW = 20_000
#: Edges for each file, and so for each task, of a step: two numbers each.
PER_FILE = 50_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (columns a, b, both bigint); component is the least id reachable.

    Each step replaces edges by edges to smaller ids, until all edges lead to the least id. The minimum of an id's
    neighbours is pre-aggregated before the shuffle, and hubs are joined apart (see ``skew``). Links from an id to
    itself and nulls are left out; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = written(edges)
    count = edges.count()
    if not count:
        return edges.toDF("id", "component")
    state, many = None, count >= FEW
    files = max(1, count // PER_FILE)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        meet = keyed_join if many else DataFrame.join
        large, halfway = written(meet(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(files))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = meet(large, least, "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges, now_at = written(small.where("a != b").distinct().coalesce(files))
        discard(spark, path, halfway)
        path = now_at
        # a fingerprint of the edge set that no number of edges can overflow
        with cleaning(spark):
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            break
        state = now
    least = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(least.distinct())
