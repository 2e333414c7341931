"""Sinks: delimited files and appends to tables."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.types import published

QUOTE_NONE, QUOTE_STRINGS, QUOTE_ALL = 0, 1, 2


def _as_text(df: DataFrame, quoting: int, quote: str, null: str) -> DataFrame:
    """Each column as the text that goes into the file."""
    shown = published(df)
    out = []
    for f in shown.schema.fields:
        c = F.col(f"`{f.name}`").cast("string")
        if quoting == QUOTE_ALL or quoting == QUOTE_STRINGS and isinstance(f.dataType, T.StringType):
            c = F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        out.append(F.coalesce(c, F.lit(null)).alias(f.name))
    return shown.select(*out)


def dump_file(df: DataFrame, path: str, separator: str = ",", quoting: int = QUOTE_STRINGS, line_end: str = "\n", null: str = "NULL", single: bool = False) -> None:
    """A folder of delimited text files, or one file at ``path`` with ``single``. Existing paths are not overwritten.

    One file means one task writes all rows; for large results leave ``single`` off.
    """
    rows = _as_text(df, quoting, '"', null)
    head = separator.join(f'"{c}"' if quoting != QUOTE_NONE else c for c in rows.columns)
    lines = rows.select(F.concat_ws(separator, *[F.col(f"`{c}`") for c in rows.columns]).alias("value"))
    spark = df.sparkSession
    if not single:
        lines.write.mode("error").option("lineSep", line_end).text(path)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    folder = f"{path}.parts"
    ordered = spark.createDataFrame([(head,)], "value string").unionAll(lines).coalesce(1)
    ordered.write.mode("error").option("lineSep", line_end).text(folder)
    parts = jvm.org.apache.hadoop.fs.Path(folder)
    part = next(f.getPath() for f in system.listStatus(parts) if f.getPath().getName().startswith("part-"))
    if not system.rename(part, target):
        raise OSError(f"cannot move the result to {path}")
    system.delete(parts, True)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Appends all rows or none: batches go to a table beside it, side by side, and from there in one transaction."""
    beside = f"{table}_{uuid.uuid4().hex[:8]}"
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for key, value in options.items():
        if key != "driver":
            properties.setProperty(key, str(value))

    def run(*statements: str) -> None:
        connection = jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            quote = connection.getMetaData().getIdentifierQuoteString().strip()
            for s in statements:
                statement.executeUpdate(s.replace("`", quote))
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    columns = ", ".join(f"`{c}`" for c in df.columns)
    try:
        df.write.mode("errorifexists").format("jdbc").options(url=url, dbtable=beside, batchsize=batch, **options).save()
        run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {beside}")
    finally:
        with suppress(Exception):  # it may not have been made
            run(f"DROP TABLE {beside}")


def insert_into(df: DataFrame, table: str) -> None:
    df.write.insertInto(table)
