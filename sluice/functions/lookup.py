"""Lookup of addresses in a table of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BROADCAST = 500_000  # ranges, of some hundred bytes each


def ip_number(ip: Column) -> Column:
    """A dotted address as a number; NULL if it is none."""
    parts = F.split(ip, r"\.")
    byte = lambda k: F.try_element_at(parts, F.lit(k + 1)).try_cast("long")
    sound = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*(byte(k) for k in range(4))) <= 255)
    return F.when(sound, sum((byte(k) * 256 ** (3 - k) for k in range(1, 4)), byte(0) * 256**3))


def ip_to_country(df: DataFrame, ip: str, ranges: DataFrame, name: str = "country", bits: int = 16) -> DataFrame:
    """df with the country of each address, from ranges (first long, last long, country) that don't overlap.

    Ranges are cut at blocks of 2^bits addresses, so that the lookup is an equi-join on the block with
    the bounds as a residual. Up to BROADCAST cut ranges, which are counted, are sent to every task; more
    are shuffled, where rows without an address are spread by a hash, as no range can hold them.
    """
    block = 1 << bits
    cut = ranges.select(
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("__block"),
        F.col("first").alias("__first"),
        F.col("last").alias("__last"),
        F.col("country").alias(name),
    )
    n = df.withColumn("__ip", ip_number(F.col(ip))).withColumn("__at", F.floor(F.col("__ip") / block))
    if cut.limit(BROADCAST + 1).count() <= BROADCAST:
        cut = F.broadcast(cut)
    else:
        n = n.withColumn("__at", F.coalesce("__at", -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))))
    found = n.join(cut, (F.col("__at") == F.col("__block")) & F.col("__ip").between(F.col("__first"), F.col("__last")), "left")
    return found.select(*df.columns, name)
