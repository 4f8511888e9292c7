"""SQL templates with {{name}} placeholders, rendered as typed literals."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession

_PARTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\{\{\s*(\w+)\s*\}\}|--[^\n]*|/\*.*?\*/|[^'{/\-]+|.", re.DOTALL)
_NAME = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def literal(value: Any) -> str:
    """A value as an SQL literal of its type."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | Decimal):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D" if value == value and abs(value) != float("inf") else f"DOUBLE('{value}')"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(' ')}'" if value.tzinfo is None else f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + escaped(value) + "'"
    if isinstance(value, list | tuple):
        if not value:
            raise ValueError("an empty list has no SQL form")
        return "(" + ", ".join(map(literal, value)) + ")"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def render_file(spark: SparkSession, path: str, params: Mapping[str, Any]) -> str:
    """render() of a template that is a text file, at any path that Spark reads."""
    return render(spark.read.text(path, wholetext=True).first()[0], params)


def render(template: str, params: Mapping[str, Any]) -> str:
    """The template with every placeholder filled in: inside quotes as escaped text, elsewhere as a literal.

    Comments are left alone. A placeholder without a parameter, or a parameter without one, is an error.
    """
    used = set()

    def value(name: str) -> Any:
        if name not in params:
            raise KeyError(f"no parameter {name!r}")
        used.add(name)
        return params[name]

    out = []
    for m in _PARTS.finditer(template):
        part = m[0]
        if m[1]:
            part = literal(value(m[1]))
        elif part[0] == "'":
            part = _NAME.sub(lambda n: escaped(str(value(n[1]))), part)
        out.append(part)
    if unused := set(params) - used:
        raise KeyError(f"unused parameters: {', '.join(sorted(unused))}")
    return "".join(out)
