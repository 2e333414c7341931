"""Ranks over all rows or within groups, without bringing a group (or all rows) into one task.

The sort key is cut into ranges; rows are numbered inside each (group, range) and the counts of the ranges before
are added. Ranges number a few for each shuffle partition, so a group that holds a third of all rows is spread over
as many tasks. Only the counts, one row for each group and range, are summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 4


def range_count(df: DataFrame) -> int:
    return RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffle_key(seed: int, *columns: str) -> Column:
    """A hexadecimal string, equally likely to be anywhere, the same in every run. Nulls count as ''."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def range_of_key(key: Column, ranges: int) -> Column:
    """Which of so many equal ranges a hexadecimal string of ``shuffle_key`` lies in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * ranges / F.lit(float(1 << 32))).cast("int")


def ranked(df: DataFrame, groups: list[str], piece: str, order: list, rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with a rank from 0 (bigint) and the number of rows of the group.

    ``piece`` is an int column that rises with the order; groups must not be null. No groups: over all rows.
    """
    counts = df.groupBy(*groups, piece).agg(F.count("*").alias("_rows"))
    inside = Window.partitionBy(*groups)
    counts = counts.withColumn("_before", F.sum("_rows").over(inside.orderBy(piece)) - F.col("_rows"))
    counts = counts.withColumn(total, F.sum("_rows").over(inside)).drop("_rows")
    local = F.row_number().over(Window.partitionBy(*groups, piece).orderBy(*order)) - 1
    out = df.withColumn("_local", local).join(counts, [*groups, piece])
    return out.withColumn(rank, (F.col("_before") + F.col("_local")).cast("bigint")).drop("_before", "_local")
