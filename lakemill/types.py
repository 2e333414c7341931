"""Declared column types of the dialect as Spark types, and the form of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The dialect's type names. FLOAT is a double; decimals are doubles (use integers where digits count).
TYPES: dict[str, T.DataType] = {
    "int": T.LongType(), "integer": T.LongType(), "int32": T.LongType(), "int64": T.LongType(), "long": T.LongType(),
    "float32": T.FloatType(), "float": T.DoubleType(), "double": T.DoubleType(), "float64": T.DoubleType(), "decimal": T.DoubleType(),
    "string": T.StringType(), "str": T.StringType(), "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(), "date": T.TimestampNTZType(), "timestamp": T.TimestampType(),
}


def spark_type(name: str) -> T.DataType:
    try:
        return TYPES[name.strip().lower().split("(")[0]]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def schema_of(columns: dict[str, str]) -> T.StructType:
    """A declared schema; nothing is inferred."""
    return T.StructType([T.StructField(name, spark_type(kind)) for name, kind in columns.items()])


def published(df: DataFrame) -> DataFrame:
    """Results as callers see them: integers as bigint, date-times as text to the second, timestamps as epoch seconds."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.DateType)):
            c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_timestamp(c)
        out.append(c.alias(f.name))
    return df.select(*out)
