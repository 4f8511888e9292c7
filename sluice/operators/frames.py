"""Projection, filtering, aggregation, order and set operators.

All stay lazy and inside Catalyst: filters and columns reach the scan, aggregates combine before
they shuffle, and an ordered limit becomes a top-k on each task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def project(df: DataFrame, *columns: str | Column, **named: str | Column) -> DataFrame:
    """SELECT of columns; keyword arguments name expressions."""
    return df.select(*columns, *(_column(c).alias(n) for n, c in named.items()))


def all_columns(df: DataFrame) -> DataFrame:
    """SELECT *."""
    return df.select("*")


def first_row(df: DataFrame) -> Row | None:
    """The only or first row, or None; order the frame first if it matters which."""
    return df.limit(1).first()


def filtered(df: DataFrame, condition: str | Column) -> DataFrame:
    """WHERE; unknown conditions drop the row."""
    return df.filter(condition)


def between(df: DataFrame, column: str | Column, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Rows with start <= column < end; either bound may be missing."""
    c = _column(column)
    if start is not None:
        df = df.filter(c >= _instant(start))
    return df if end is None else df.filter(c < _instant(end))


_PIECES = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\?|[^'\"`?]+|.", re.DOTALL)


def map_column(df: DataFrame, name: str, template: str) -> DataFrame:
    """Replace a column by an SQL expression in which ? outside quotes stands for the column."""
    quoted = "`" + name.replace("`", "``") + "`"
    return df.withColumn(name, F.expr("".join(quoted if piece == "?" else piece for piece in _PIECES.findall(template))))


def cast_as(df: DataFrame, schema: StructType | str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """The frame as rows of another type: its fields in order, cast; renames maps a field to the column it comes from.

    A field whose metadata list `aliases` takes the first alias that the frame has, if it has no column of its name.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have, chosen = set(df.columns), []
    for f in fields:
        names = [(renames or {}).get(f.name, f.name), *f.metadata.get("aliases", [])]
        source = next((n for n in names if n in have), names[0])
        chosen.append(df[source].cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*chosen)


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """COUNT(*) as one row."""
    return df.agg(F.count("*").alias(name))


def total(df: DataFrame, column: str | Column, name: str = "total") -> DataFrame:
    """SUM as one row, in Spark's widened type; NULL over no values."""
    return df.agg(F.sum(_column(column)).alias(name))


def aggregate(df: DataFrame, **named: Column) -> DataFrame:
    """Aggregates over all rows, by name."""
    return df.agg(*(c.alias(n) for n, c in named.items()))


def grouped(df: DataFrame, keys: Iterable[str | Column], **named: Column) -> DataFrame:
    """Aggregates by keys, by name."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in named.items()))


def ordered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """ORDER BY, ascending unless a column says otherwise."""
    return df.orderBy(*columns)


def limit(df: DataFrame, rows: int, offset: int = 0) -> DataFrame:
    """Skip `offset` rows, then take `rows`; the frame should be in a total order."""
    return (df.offset(offset) if offset else df).limit(rows)


def union_all(df: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by position."""
    return reduce(DataFrame.union, others, df)


def union_distinct(df: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION: the set of all rows."""
    return union_all(df, *others).distinct()


def merge(df: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, NULL where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, df)


def for_each(df: DataFrame, values: Iterable[Any], make: Callable[[DataFrame, Any], DataFrame]) -> list[DataFrame]:
    """One frame for each parameter value."""
    return [make(df, v) for v in values]


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _instant(x: datetime | str) -> Column:
    return F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else F.lit(x.replace(tzinfo=None)).cast("timestamp_ntz")
