"""Tables by name: where each comes from, who owns it, and which source answers for a name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Reader = Callable[[SparkSession], DataFrame]


@dataclass
class Table:
    name: str
    read: Reader
    owner: str = ""
    columns: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    sink: Callable[[DataFrame], None] | None = None


def kind_of(data_type: T.DataType) -> str:
    """What the dialect's rules by type need to know of a column."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int32"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "bool" if isinstance(data_type, T.BooleanType) else "number" if isinstance(data_type, T.NumericType) else ""


class Router:
    """``db.table`` to a source: the exact name, then ``db.*``, then ``*``."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules

    def route(self, name: str) -> str:
        for rule in (name, f"{name.split('.')[0]}.*", "*.*", "*"):
            if rule in self.rules:
                return self.rules[rule]
        raise KeyError(f"no source for {name}")


class Catalog:
    """Registered tables become temporary views, so that plain Spark SQL sees them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def add(self, table: Table) -> DataFrame:
        df = table.read(self.spark)
        table.columns = df.columns
        table.kinds = {f.name.lower(): kind_of(f.dataType) for f in df.schema.fields}
        self.tables[table.name.lower()] = table
        df.createOrReplaceTempView(self.view_of(table.name))
        return df

    @staticmethod
    def view_of(name: str) -> str:
        """The view of a table; ``db.table`` has one of its own."""
        return name.replace(".", "__")

    def get(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise KeyError(f"table {name} is not registered") from None

    def drop(self, name: str) -> None:
        self.tables.pop(name.lower(), None)
        self.spark.catalog.dropTempView(self.view_of(name))
