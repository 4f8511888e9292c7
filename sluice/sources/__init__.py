"""Sources, sinks and the catalog."""

from sluice.sources.catalog import Database, TableSchema, database
from sluice.sources.files import from_file, from_jdbc, from_rows
from sluice.sources.sinks import SCHEMES, export

__all__ = ["SCHEMES", "Database", "TableSchema", "database", "export", "from_file", "from_jdbc", "from_rows"]
