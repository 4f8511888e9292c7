"""Export of frames to targets, by the target's scheme."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame


def _files(form: str) -> Callable[[DataFrame, str, dict[str, str]], None]:
    def write(df: DataFrame, where: str, options: dict[str, str]) -> None:
        mode, by = options.pop("mode", "errorifexists"), options.pop("partition_by", "")
        writer = df.write.format(form).mode(mode).options(**options)
        (writer.partitionBy(*by.split(",")) if by else writer).save(where)

    return write


def _table(df: DataFrame, where: str, options: dict[str, str]) -> None:
    df.write.mode(options.pop("mode", "errorifexists")).saveAsTable(where.strip("/").replace("/", "."))


def _console(df: DataFrame, where: str, options: dict[str, str]) -> None:
    df.show(int(options.get("rows", 20)), truncate=False)


#: Writers by scheme; add to it to export elsewhere.
SCHEMES: dict[str, Callable[[DataFrame, str, dict[str, str]], None]] = {
    **{form: _files(form) for form in ("parquet", "orc", "csv", "json")},
    "table": _table,
    "console": _console,
}


def export(df: DataFrame, target: str) -> None:
    """Writes df to scheme://place?option=value, e.g. parquet:///out/day?mode=overwrite or table://db/name."""
    scheme, _, rest = target.partition("://")
    if scheme not in SCHEMES or not _:
        raise ValueError(f"no export for {target!r}; known: {', '.join(sorted(SCHEMES))}")
    parts = urlsplit(f"x://{rest}")
    SCHEMES[scheme](df, parts.netloc + parts.path, dict(parse_qsl(parts.query)))
