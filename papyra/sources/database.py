"""Read-only scan of a SQLite file as a Spark data source; there is no writer."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_KINDS = {"INT": "long", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    """Neither the file nor a journal is ever written."""
    c = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)
    c.execute("pragma query_only = on")
    return c


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: ``path``, ``table``, ``partitions`` (ranges of the row id, 8). The file must be readable on every executor."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _open(self.options["path"]) as c:
            columns = c.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {next((k for start, k in _KINDS.items() if kind.upper().startswith(start)), 'string')}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path, self.table, self.n = schema.names, options["path"], options["table"], int(options.get("partitions", 8))

    def partitions(self) -> list[Rows]:
        with _open(self.path) as c:
            low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = (high - low) // self.n + 1
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with _open(self.path) as c:
            yield from c.execute(f"select {', '.join(map(_quoted, self.columns))} from {_quoted(self.table)} where rowid between ? and ?", (partition.low, partition.high))


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file, read in ranges of its row id; tables without row ids fail."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()
