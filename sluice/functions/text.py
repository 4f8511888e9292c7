"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """The pattern's group; NULL where nothing matches, so that coalesce() falls through."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
