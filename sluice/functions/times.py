"""Functions over unix times in seconds, as Column builders and as SQL functions of the session."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Units of signed durations, and the forms that instants are written in.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH",
    "yyyy-MM-dd",
)


def seconds(duration: str) -> int:
    """Seconds of a signed duration such as '-30d', '1h' or '+1d12h'."""
    m = re.fullmatch(r"([+-]?)((?:\d+[smhdw])+)", duration.strip())
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    total = sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)([smhdw])", m[2]))
    return -total if m[1] == "-" else total


def time_format(time: Column, form: str, zone: str = "UTC") -> Column:
    """A unix time as text, in a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(time), zone), form)


def time_range(time: Column, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """start <= time < end; a missing bound is open."""
    bounds = [] if start is None else [time >= start]
    bounds += [] if end is None else [time < end]
    return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else F.lit(True)


def time_add(time: Column, duration: str) -> Column:
    """A unix time moved by a signed duration. Days have 24 hours."""
    return time + F.lit(seconds(duration))


def parse_instant(text: Column) -> Column:
    """An instant from any of FORMS; NULL where none fits. Without a zone it is in the session's."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMS))


def register(spark: SparkSession) -> None:
    """Adds time_format, time_range, time_since and time_add to the session's SQL functions.

    They are SQL bodies, which Catalyst inlines: a range still becomes a pushed filter.
    """
    unit = " ".join(f"WHEN '{u}' THEN {n}" for u, n in UNITS.items())
    for name, body in {
        "time_format(t BIGINT, form STRING, zone STRING) RETURNS STRING": "date_format(from_utc_timestamp(timestamp_seconds(t), zone), form)",
        "time_range(t BIGINT, since BIGINT, until BIGINT) RETURNS BOOLEAN": "t >= since AND t < until",
        "time_since(t BIGINT, since BIGINT) RETURNS BOOLEAN": "t >= since",
        "time_add(t BIGINT, duration STRING) RETURNS BIGINT": f"""CASE WHEN trim(duration) RLIKE '^[+-]?([0-9]+[{"".join(UNITS)}])+$' THEN
            t + CASE WHEN trim(duration) LIKE '-%' THEN -1 ELSE 1 END * aggregate(regexp_extract_all(duration, '([0-9]+[a-z])', 1), 0L,
            (total, x) -> total + CAST(left(x, length(x) - 1) AS BIGINT) * CASE right(x, 1) {unit} END)
            WHEN duration IS NOT NULL THEN CAST(raise_error(concat('not a duration: ', duration)) AS BIGINT) END""",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
