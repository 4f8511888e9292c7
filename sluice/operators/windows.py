"""Partitioned views of a frame, analytic columns, and windows of fixed size or duration."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_ROW = "__row"


@dataclass(frozen=True)
class Partitioned:
    """A frame with partition keys and, once ordered, a total order in each partition."""

    df: DataFrame
    keys: tuple[str | Column, ...]
    order: tuple[str | Column, ...] = ()

    def order_by(self, *columns: str | Column) -> Partitioned:
        return replace(self, order=columns)

    def _sorting(self) -> list[Column]:
        return [F.col(c) if isinstance(c, str) else c for c in self.order or self.df.columns]

    def window(self) -> WindowSpec:
        """In order; without one, all columns ascending, so that results never depend on chance."""
        return Window.partitionBy(*self.keys).orderBy(*self._sorting())

    def whole(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def firsts(self) -> DataFrame:
        """The first row of each partition."""
        return self.df.withColumn(_ROW, F.row_number().over(self.window())).filter(F.col(_ROW) == 1).drop(_ROW)

    def lasts(self) -> DataFrame:
        """The last row of each partition."""
        back = Window.partitionBy(*self.keys).orderBy(*map(_reverse, self.order or self.df.columns))
        return self.df.withColumn(_ROW, F.row_number().over(back)).filter(F.col(_ROW) == 1).drop(_ROW)

    def first(self, column: str) -> Column:
        return F.first(column).over(self.whole())

    def last(self, column: str) -> Column:
        return F.last(column).over(self.whole())

    def nth(self, column: str, n: int) -> Column:
        """The nth row's value, counted from 1."""
        return F.nth_value(column, n).over(self.whole())

    def lag(self, column: str, offset: int = 1, default: object = None) -> Column:
        return F.lag(column, offset, default).over(self.window())

    def lead(self, column: str, offset: int = 1, default: object = None) -> Column:
        return F.lead(column, offset, default).over(self.window())

    def select(self, *columns: str | Column, **named: Column) -> DataFrame:
        """Columns of each row beside analytic ones, by name."""
        return self.df.select(*columns, *(c.alias(n) for n, c in named.items()))

    def fixed_size(self, rows: int, name: str = "window_id") -> DataFrame:
        """Numbers windows of `rows` rows in each partition, from 0; the last may be short."""
        if not self.order:
            raise ValueError("windows of a fixed size need an order")
        return self.df.withColumn(name, F.floor((F.row_number().over(self.window()) - 1) / F.lit(rows)).cast("long"))


def partitioned(df: DataFrame, *keys: str | Column) -> Partitioned:
    """PARTITION BY one key or more."""
    return Partitioned(df, keys)


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str | Column] = (), **named: Column) -> DataFrame:
    """Aggregates by windows of a fixed duration that don't overlap, and by keys."""
    return sliding(df, time, size, size, keys, **named)


def sliding(df: DataFrame, time: str, size: str, step: str, keys: Sequence[str | Column] = (), **named: Column) -> DataFrame:
    """Aggregates by windows of a duration that start a step apart, and by keys; columns window_start and window_end come first."""
    at = F.window(time, size) if size == step else F.window(time, size, step)
    out = df.groupBy(at.alias("__window"), *keys).agg(*(c.alias(n) for n, c in named.items()))
    return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *(c for c in out.columns if c != "__window"))


def _reverse(c: str | Column) -> Column:
    """A column's order turned around, with its nulls."""
    if isinstance(c, str):
        return F.col(c).desc_nulls_last()
    text = str(c._jc.toString()) if hasattr(c, "_jc") else ""
    if re.search(r" DESC NULLS (FIRST|LAST)$", text):
        raise ValueError("lasts() takes ascending columns; use firsts() for a descending order")
    return c.desc_nulls_last()
