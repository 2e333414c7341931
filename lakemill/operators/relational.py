"""Relational operations with the reference semantics that Spark's own calls don't give in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_LEAST_GROUP = 4


def group_agg(df: DataFrame, keys: list, aggs: list[Column], least_group: int = DEFAULT_LEAST_GROUP) -> DataFrame:
    """Grouped aggregation that shows only groups of at least ``least_group`` rows; 1 shows all."""
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_group_rows"))
    return out.where(F.col("_group_rows") >= least_group).drop("_group_rows") if least_group > 1 else out.drop("_group_rows")


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows without a match. Nulls match nothing, so they stay; NOT IN in SQL text has SQL's three values."""
    return df.join(other, on, "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """``df`` with a boolean column: whether the key is among the other's."""
    keys = other.select(F.col(other_key).alias("_key")).where("_key is not null").distinct()
    out = df.join(keys, df[key] == F.col("_key"), "left")
    return out.withColumn(name, F.col("_key").isNotNull()).drop("_key")


def quantified(df: DataFrame, value: Column, op: str, kind: str, other: DataFrame, column: str) -> DataFrame:
    """Rows for which ``value op ANY/ALL (column of other)`` is true, with SQL's answers for no rows and nulls.

    The other side is reduced to one row (least, greatest, counts) before it meets ``df``.
    """
    facts = other.agg(F.min(column).alias("_min"), F.max(column).alias("_max"), F.count("*").alias("_n"), F.count(column).alias("_known"))
    low, high = F.col("_min"), F.col("_max")
    some_null = F.col("_known") < F.col("_n")
    differ = (value != low) | (value != high)
    every = {"<": value < low, "<=": value <= low, ">": value > high, ">=": value >= high, "=": ~differ, "<>": (value < low) | (value > high)}
    some = {"<": value < high, "<=": value <= high, ">": value > low, ">=": value >= low, "<>": differ}
    if (op, kind) == ("=", "ANY"):
        return df.where(value.isNotNull()).join(other.select(F.col(column).alias("_q")), value == F.col("_q"), "left_semi")
    if (op, kind) == ("<>", "ALL"):
        met = df.join(other.select(F.col(column).alias("_q")), value == F.col("_q"), "left_anti").crossJoin(F.broadcast(facts))
        return met.where((F.col("_n") == 0) | (value.isNotNull() & ~some_null)).drop("_min", "_max", "_n", "_known")
    met = df.crossJoin(F.broadcast(facts))  # one row
    test = some[op] if kind == "ANY" else (F.col("_n") == 0) | (every[op] & ~some_null)
    return met.where(test).drop("_min", "_max", "_n", "_known")


def window(partition: list, order: list | None = None) -> WindowSpec:
    out = Window.partitionBy(*partition)
    return out.orderBy(*order) if order else out


def limit_offset(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    if count <= 0:
        raise ValueError("LIMIT 0 is not supported")
    return df.offset(offset).limit(count)


def concat(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION by position; with ``distinct`` equal rows of both sides become one."""
    out = left.unionAll(right)
    return out.distinct() if distinct else out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows dealt by a key, so that later joins and groups on it need no other shuffle."""
    return df.repartition(buckets, key)


def top_per_group(df: DataFrame, partition: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group; a group-limit runs before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(window(partition, order))).where(F.col("_rank") <= k).drop("_rank")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a random order: dealt to random partitions and sorted inside them, without a global sort."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_order", F.rand(seed)).repartition(n, "_order").sortWithinPartitions("_order").drop("_order")


def shape(df: DataFrame) -> DataFrame:
    """One row: row_count and column_count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


#: Relative rank error asked of Spark's percentile sketch, as its inverse.
ACCURACY = 10_000


def percentile_disc(df: DataFrame, keys: list[str], value: str, p: float, name: str = "p") -> DataFrame:
    """For each group the value at ceil(p * n) of its n non-null values in order, in the values' own type; null if none.

    A sketch brackets the value; only the few values between the brackets are counted one by one, so no task holds a
    group's distinct values, and the rows are pre-aggregated before both shuffles.
    """
    if not 0 <= p <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    row = df.select(*keys, F.col(value).alias("_v"))
    keyed = [F.coalesce(F.struct(*keys), F.struct(*keys)).alias("_k")] if keys else [F.lit(0).alias("_k")]
    row = row.select(*keyed, "_v")
    margin = 4 / ACCURACY
    at = F.percentile_approx("_v", [max(p - margin, 0.0), min(p + margin, 1.0)], ACCURACY)
    cuts = row.groupBy("_k").agg(at.alias("_at"), F.count("_v").alias("_n"))
    cuts = cuts.select("_k", "_n", F.col("_at")[0].alias("_low"), F.col("_at")[1].alias("_high"), F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1)).alias("_rank"))
    near = row.join(cuts.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g")))
    # all values below the bracket count as one
    near = near.where("_v <= _high").groupBy("_k", "_rank", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    running = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()))
    met = near.withColumn("_upto", running).where("_upto >= _rank").groupBy("_k").agg(F.min("_v").alias(name))
    out = cuts.select(F.col("_k").alias("_g")).join(met, F.col("_g").eqNullSafe(F.col("_k")), "left")
    return out.select(*[F.col("_g").getField(k).alias(k) for k in keys], name)


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str] = (), pieces: int | None = None) -> DataFrame:
    """``df`` with row_number, rank, percent_rank and group_rows of each row in its group, by ``order`` (nulls first) then ``ties``.

    Rows are cut into pieces by quantiles of ``order`` and numbered inside each (group, piece); the counts of the pieces
    before are added. So a group that holds most rows is spread over the pieces; only the counts are summed in order.
    Row numbers of rows that are equal in ``order`` and ``ties`` may change places.
    """
    spark = df.sparkSession
    n = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], ACCURACY)).first()[0] if n > 1 else None
    piece = F.lit(0)
    if cuts:
        distinct = sorted(set(cuts))
        piece = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in distinct]), lambda c: c <= F.col(order))), F.lit(-1))
    rows = df.withColumn("_piece", F.when(F.col(order).isNull(), -1).otherwise(piece))
    groups = F.struct(*keys) if keys else F.lit(0)
    rows = rows.withColumn("_k", groups)
    counts = rows.groupBy("_k", "_piece").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_k")
    counts = counts.withColumn("_before", F.sum("_c").over(whole.orderBy("_piece")) - F.col("_c")).withColumn("group_rows", F.sum("_c").over(whole))
    inside = Window.partitionBy("_k", "_piece").orderBy(F.col(order).asc_nulls_first())
    rows = rows.withColumn("_rank", F.rank().over(inside)).withColumn("_row", F.row_number().over(inside.orderBy(F.col(order).asc_nulls_first(), *ties)))
    rows = rows.join(counts.select(F.col("_k").alias("_ck"), F.col("_piece").alias("_cp"), "_before", "group_rows"), F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_piece") == F.col("_cp")))
    rank = F.col("_before") + F.col("_rank")
    percent = F.when(F.col("group_rows") > 1, (rank - 1) / (F.col("group_rows") - 1)).otherwise(0.0)
    return rows.select(*df.columns, (F.col("_before") + F.col("_row")).alias("row_number"), rank.alias("rank"), percent.alias("percent_rank"), "group_rows")


def first_row(df: DataFrame, keys: list[str], value: str, order: str, name: str = "first") -> DataFrame:
    """For each group the value of its first row by ``order``, also if that is null."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v")), order).getField("v").alias(name))
