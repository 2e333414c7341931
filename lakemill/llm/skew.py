"""Joins that stay spread when one key holds a large part of all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill.llm.blocks import checkpointed, cleaning

#: At most so many keys are joined by broadcast, and only keys with at least so many rows.
HOT_KEYS, HOT_ROWS = 1000, 500
#: Ids (8 bytes each) up to which a set of ids is broadcast instead of shuffling what it filters.
MOST_IDS = 2_000_000


def keyed_join(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row for each key at most; keys must not be null.

    The ``HOT_KEYS`` keys with the most rows of ``left`` meet their rows of ``right`` by broadcast, ``HOT_KEYS`` rows
    whatever the input; each other key holds less than 1 / ``HOT_KEYS`` of all rows or less than ``HOT_ROWS``. Both
    sides are read more than once and should be cheap to read again.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT_ROWS)
    with cleaning(left.sparkSession):
        hot = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*keys).collect()
    if not hot:
        return left.join(right, [*keys], how)
    values = [c for c in right.columns if c not in keys]
    # as an Arrow table: of a list, Spark would make rows by Python workers of another kind on every executor
    chosen = left.sparkSession.createDataFrame(pa.Table.from_pylist([r.asDict() for r in hot], to_arrow_schema(left.select(*keys).schema)))
    few = F.broadcast(chosen).join(right.withColumn("_in", F.lit(True)), [*keys], "left")
    few = few.select(*keys, *[F.col(c).alias(f"_few_{c}") for c in values], F.col("_in").alias("_few_in"), F.lit(True).alias("_hot"))
    rows = left.join(F.broadcast(few), [*keys], "left")
    # rows of hot keys have been met: they are dealt anywhere, and meet nothing here
    salt = F.when(F.col("_hot"), F.greatest(F.abs(F.xxhash64(*left.columns) % (1 << 40)), F.lit(1))).otherwise(F.lit(0))
    rest = right.select(*keys, *[F.col(c).alias(f"_rest_{c}") for c in values], F.lit(True).alias("_rest_in"), F.lit(0).cast("bigint").alias("_salt"))
    rows = rows.withColumn("_salt", salt.cast("bigint")).join(rest, [*keys, "_salt"], "left")
    if how == "inner":
        rows = rows.where("_few_in or _rest_in")
    return rows.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_few_{c}")).otherwise(F.col(f"_rest_{c}")).alias(c) for c in values])


def only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = MOST_IDS) -> DataFrame:
    """``rows`` whose key is among ``ids`` (one bigint column), or with ``left_anti`` is not; null keys are not.

    Up to ``most`` ids are broadcast, so that ``rows``, which may carry whole texts, are filtered where they are read;
    more are met by a shuffle.
    """
    ids = checkpointed(ids.select(F.col(ids.columns[0]).cast("bigint").alias("_id")).where("_id is not null").distinct())
    side = F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
    return rows.join(side, F.col(key).cast("bigint") == F.col("_id"), how)
