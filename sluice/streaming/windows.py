"""Windowed aggregates over streams, and runs that take what is new and end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", pattern: str | None = None, **options: str) -> DataFrame:
    """A stream of the files of a folder; pattern picks some by name. Zone-free times become instants, as watermarks need."""
    reader = spark.readStream.format(form).schema(schema).options(**options)
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    return df.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes))


def windowed(df: DataFrame, time: str, size: str, step: str | None = None, keys: Sequence[str] = (), late: str | None = None, **named: Column) -> DataFrame:
    """Aggregates by tumbling windows, or sliding ones if a step is given; late: how long rows may come late."""
    source = df.withWatermark(time, late) if late else df
    at = F.window(time, size, step) if step else F.window(time, size)
    out = source.groupBy(at.alias("w"), *keys).agg(*(c.alias(n) for n, c in named.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *named)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str | None = None, **named: Column) -> DataFrame:
    """Aggregates by sessions: runs of a key's rows less than a gap apart."""
    source = df.withWatermark(time, late) if late else df
    out = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in named.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *named)


def counted_windows(df: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """(key, window_id, n, total) for every `rows` rows of a key, as they arrive; a short last window waits for more.

    Rows of a null value count, and add nothing to the total.
    """
    kind = dict(df.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for part in parts:
            values, at = part[value].fillna(0).to_numpy(dtype=float), 0
            while at < len(values):
                some = values[at : at + rows - n]
                at, n, total = at + len(some), n + len(some), total + float(some.sum())
                if n == rows:
                    out.append((k[0], window, n, total))
                    window, n, total = window + 1, 0, 0.0
        state.update((window, n, total))
        yield pd.DataFrame(out, columns=[key, "window_id", "n", "total"])

    schema = f"`{key}` {kind}, window_id long, n long, total double"
    return df.groupBy(key).applyInPandasWithState(step, schema, "window_id long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, target: str, checkpoint: str | None = None, mode: str = "complete", form: str = "memory") -> StreamingQuery:
    """Takes all that is new, writes it to a memory table or a folder, and ends; a checkpoint lets the next run go on."""
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).format(form)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.queryName(target).start() if form == "memory" else writer.start(target)
    query.awaitTermination()
    return query
