"""DataFrame-to-DataFrame operators: plain functions for df.transform."""

from sluice.operators.frames import (
    aggregate,
    all_columns,
    between,
    cast_as,
    filtered,
    first_row,
    for_each,
    grouped,
    limit,
    map_column,
    merge,
    ordered,
    project,
    row_count,
    total,
    union_all,
    union_distinct,
)
from sluice.operators.windows import Partitioned, partitioned, sliding, tumbling

__all__ = [
    "Partitioned", "aggregate", "all_columns", "between", "cast_as", "filtered", "first_row", "for_each", "grouped", "limit", "map_column", "merge",
    "ordered", "partitioned", "project", "row_count", "sliding", "total", "tumbling", "union_all", "union_distinct",
]
