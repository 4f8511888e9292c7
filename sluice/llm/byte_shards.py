"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are dealt into ranges of doc_id and kept as (range, sizes) in the shared folder. Each range's
total gives its offset; within a range a running sum gives each row's own offset, and the row's
middle byte decides its shard: shard k holds the rows whose middle lies in the k-th part of all
bytes. A shard's size misses the target by at most one row at each end. Built-in SQL functions only.

Defined results: a null text has no bytes; every row counts one byte more than its text; equal
doc_ids are ordered by checksum and size; null doc_ids come first; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import keep


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts the rows of a shard from 0, in order of doc_id."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )

    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")  # as many rows as there are ranges
        .select(
            *("doc_id", "size", "text_crc32"),
            F.expr(f"cast(least({shards} - 1, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * all_bytes)) as int)").alias("shard"),
            (F.col("rows_before") + F.col("row")).alias("rank"),
        )
    )
    placed = keep(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
