"""Sources by kind. CSV columns are declared; other kinds carry their types."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.types import schema_of


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def allowed(path: str, root: str | None) -> str:
    """``path`` if it lies in the folder ``root`` (a URI or a path), where one is set."""
    inside = posixpath.normpath(path) + "/"
    if root and not inside.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} lies outside {root}")
    return path


def read_csv(
    spark: SparkSession, path: str, columns: dict[str, str], null: str = "NULL", header: bool = True, separator: str = ",", root: str | None = None, store: dict[str, str] | None = None
) -> DataFrame:
    """Local or object-store CSV with declared columns; ``null`` is how a null is written, quoted or not.

    ``root`` restricts paths to a folder; ``store`` has settings of the object store (``fs.s3a.endpoint`` and so on).
    """
    options = dict(header=header, nullValue=null, sep=separator, escape='"', enforceSchema=True, mode="FAILFAST")
    return spark.read.schema(schema_of(columns)).options(**options, **(store or {})).csv(allowed(path, root))


def read_json(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.schema(schema_of(columns)).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table. With ``key`` and ``bounds`` it is read in parts side by side; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


#: JDBC drivers and URLs by kind, and the ports that servers listen on.
DATABASES = {
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{db}", 3306),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{db}", 5432),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{db}", 0),
}


def jdbc_options(kind: str, connection: str) -> dict[str, str]:
    """url, driver, user and password from "db=..;user=..;password=..;host=..;port=..", or from a URL."""
    driver, url, port = DATABASES[kind]
    if connection.startswith("jdbc:"):
        return {"url": connection, "driver": driver}
    given = dict(part.split("=", 1) for part in connection.split(";") if part)
    out = {"url": url.format(**{"host": "localhost", "port": port, "db": ""} | given), "driver": driver}
    return out | {k: given[k] for k in ("user", "password") if k in given}


def read_database(kind: str):
    def read_kind(spark: SparkSession, table: str, connection: str, **how) -> DataFrame:
        """Declared 1-bit columns of MySQL come as booleans and are shown as the numbers that they are there."""
        settings = jdbc_options(kind, connection)
        if kind == "mysql":
            settings["tinyInt1isBit"] = "false"
        return read_jdbc(spark, table=table, **settings, **how)

    return read_kind


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_flight_sql(spark: SparkSession, uri: str, query: str) -> DataFrame:
    """Arrow Flight SQL: one partition for each endpoint that the server names (see ``flight``)."""
    from lakemill.sources.flight import FlightSql

    spark.dataSource.register(FlightSql)
    return spark.read.format(FlightSql.name()).options(uri=uri, query=query).load()


#: Kinds of source; further kinds may be added.
READERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": read_parquet,
    "orc": read_orc,
    "csvdb": read_csv,
    "json": read_json,
    "jdbc": read_jdbc,
    "mysql": read_database("mysql"),
    "postgresql": read_database("postgresql"),
    "sqlite": read_database("sqlite"),
    "table": read_table,
    "arrowsql": read_flight_sql,
}


def read(spark: SparkSession, kind: str, **how) -> DataFrame:
    try:
        return READERS[kind.lower()](spark, **how)
    except KeyError as e:
        if kind.lower() in READERS:
            raise
        raise ValueError(f"unknown kind of source {kind!r}") from e
