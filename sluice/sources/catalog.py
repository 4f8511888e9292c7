"""Databases: namespaces of the catalog, their tables, and the statements that make and drop them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


@dataclass(frozen=True)
class TableSchema:
    """A table's columns: (name, type, aliases)."""

    columns: tuple[tuple[str, str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, schema: StructType) -> TableSchema:
        return cls(tuple((f.name, f.dataType.simpleString(), tuple(f.metadata.get("aliases", ()))) for f in schema))


@dataclass(frozen=True)
class Database:
    """A namespace; statements run at once, queries stay lazy."""

    spark: SparkSession
    name: str

    def create(self) -> Database:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(self.name)}")
        return self

    def drop(self) -> None:
        self.spark.sql(f"DROP SCHEMA IF EXISTS {quoted(self.name)} CASCADE")

    def exists(self) -> bool:
        return self.spark.catalog.databaseExists(self.name)

    def databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.name) if not t.isTemporary)

    def use(self) -> Database:
        self.spark.catalog.setCurrentDatabase(self.name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(quoted(self.name, name))

    def schema(self, name: str) -> TableSchema:
        return TableSchema.of(self.table(name).schema)

    def sql(self, text: str, **args: Any) -> DataFrame:
        """Any statement, with this namespace as the current one and :name parameters bound, never spliced."""
        before = self.spark.catalog.currentDatabase()
        self.spark.catalog.setCurrentDatabase(self.name)
        try:
            return self.spark.sql(text, args=args or None)
        finally:
            self.spark.catalog.setCurrentDatabase(before)

    def create_table(self, name: str, columns: str | StructType, if_absent: bool = False, form: str = "parquet", location: str | None = None) -> DataFrame:
        """CREATE TABLE; fails if the table is there, unless if_absent. Files at a location of their own outlive the table."""
        fields = StructType.fromDDL(columns) if isinstance(columns, str) else columns
        listed = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if if_absent else ''}{quoted(self.name, name)} ({listed}) USING {form}" + (f" LOCATION '{location}'" if location else ""))
        return self.table(name)

    def drop_table(self, name: str, if_present: bool = False) -> None:
        """DROP TABLE; fails if the table is missing, unless if_present."""
        self.spark.sql(f"DROP TABLE {'IF EXISTS ' if if_present else ''}{quoted(self.name, name)}")

    def insert(self, name: str, df: DataFrame) -> DataFrame:
        """Appends by column name and returns the table."""
        target = self.table(name)
        df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in target.schema)).write.insertInto(f"{self.name}.{name}")
        return self.table(name)

    def insert_period(self, name: str, df: DataFrame, period: str) -> DataFrame:
        """Replaces the partitions of `period` that df holds, so that a period which runs again isn't doubled."""
        if name not in self.tables():
            df.limit(0).write.partitionBy(period).format("parquet").saveAsTable(f"{self.name}.{name}")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # the writer's own option of that name doesn't reach insertInto
        try:
            df.select(*self.table(name).columns).write.insertInto(f"{self.name}.{name}", overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        return self.table(name)


def database(spark: SparkSession, name: str) -> Database:
    return Database(spark, name)
