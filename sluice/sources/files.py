"""Collections and files as frames."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The format of a file by its suffix.
FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "txt": "text", "text": "text", "log": "text"}
PACKED = ("gz", "bz2", "zst", "snappy", "lz4")


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: StructType | str) -> DataFrame:
    """A frame of rows in memory; the schema is always given."""
    return spark.createDataFrame(list(rows), schema)


def from_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: Any = None, high: Any = None, parts: int = 1, **options: Any) -> DataFrame:
    """A table or (query) AS name of a database as a frame, over JDBC; filters and columns are pushed to it.

    With a column and the bounds of its values, `parts` ranges of it are read side by side; rows beyond
    the bounds are in the first and last of them.
    """
    if parts > 1:
        if column is None or low is None or high is None:
            raise ValueError("to read in parts, a column and its bounds are needed")
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def from_file(spark: SparkSession, path: str, schema: StructType | str | None = None, form: str | None = None, **options: Any) -> DataFrame:
    """A file or folder as a frame, in the format of its suffix unless one is given.

    Text formats but plain text need a schema: inferring one would read everything twice.
    """
    if form is None:
        parts = PurePosixPath(path.rstrip("/")).name.lower().split(".")
        if parts[-1] in PACKED:
            parts.pop()
        if (form := FORMATS.get(parts[-1])) is None:
            raise ValueError(f"no format known for {path!r}")
        if parts[-1] == "tsv":
            options.setdefault("sep", "\t")
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    if form == "csv":
        options.setdefault("header", True)
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
