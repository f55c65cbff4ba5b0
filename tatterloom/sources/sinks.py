"""Sinks of materialised rows: CSV, Parquet, JSON lines, JDBC, and SQLite through a Python data source."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMATS = ("csv", "parquet", "json", "database")


def distinct_names(names: list[str]) -> list[str]:
    """Column names; a repeated one gets a number, and a blank one its place."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(names or ["column_1"]):
        name = name or f"column_{k + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class SqliteWriter(DataSourceWriter):
    """Appends rows to a table; SQLite has one writer, so the frame comes in one partition."""

    def __init__(self, path: str, table: str, schema: StructType, overwrite: bool):
        self.path, self.table, self.names, self.overwrite = path, table, schema.names, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        quote = lambda n: '"' + n.replace('"', '""') + '"'
        with sqlite3.connect(self.path) as db:
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quote(self.table)}")
            kinds = ["INTEGER" if n in ("chunk_index", "row_in_chunk") else "TEXT" for n in self.names]
            db.execute(f"CREATE TABLE IF NOT EXISTS {quote(self.table)} ({', '.join(f'{quote(n)} {k}' for n, k in zip(self.names, kinds, strict=True))})")
            done = db.executemany(f"INSERT INTO {quote(self.table)} VALUES ({', '.join('?' * len(self.names))})", (tuple(r) for r in rows)).rowcount
        return _Written(max(0, done))


class SqliteSource(DataSource):
    """`spark.write.format("sqlite_table")` with options path and table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema, overwrite)


def write_rows(df: DataFrame, fmt: str, target: str, chunk_rows: int | None = None, db_url: str | None = None, table: str | None = None) -> None:
    """Writes string columns in files of at most chunk_rows rows, or to a database table, in place of what was there.

    sqlite:/// URLs go to a file on this machine; other database URLs go through JDBC.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {', '.join(FORMATS)}")
    if fmt == "database":
        if not db_url:
            raise ValueError("the database format needs a URL")
        if db_url.startswith("sqlite:///"):
            SparkSession.builder.getOrCreate().dataSource.register(SqliteSource)
            df.coalesce(1).write.format("sqlite_table").option("path", db_url.removeprefix("sqlite:///")).option("table", table).mode("overwrite").save()
        else:
            df.write.jdbc(db_url, re.sub(r"\W", "_", table or "rows"), mode="overwrite")
        return
    writer = df.write.mode("overwrite")
    if chunk_rows:
        writer = writer.option("maxRecordsPerFile", chunk_rows)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(target)
