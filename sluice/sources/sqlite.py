"""SQLite files: a batch source by Spark's Python data source interface, and statements and inserts run on the driver."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Rows]:
        """Ranges of rowid, as many as the option numPartitions says."""
        with closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return []
        n = max(1, min(int(self.options.get("numPartitions", "1")), high - low + 1))
        cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [Rows(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.schema)
        with closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SQLiteSource(DataSource):
    """spark.read.format("sqlite").schema(...).option("table", t).load(path); the file must be on every machine."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, dict(self.options))


def execute(path: str, statement: str, *values: object) -> list[tuple]:
    """One statement on a database file, which is made if it is missing; the rows that it gives."""
    with closing(sqlite3.connect(path)) as db, db:
        return db.execute(statement, values).fetchall()


def insert(df: DataFrame, path: str, table: str) -> None:
    """Adds df's rows to a table of a database file, all or none; rows come to the driver a partition at a time."""
    columns = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    target = '"' + table.replace('"', '""') + '"'
    with closing(sqlite3.connect(path)) as db, db:
        db.executemany(f"INSERT INTO {target} ({columns}) VALUES ({', '.join('?' * len(df.columns))})", map(tuple, df.toLocalIterator()))
