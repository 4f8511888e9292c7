"""The Spark session and the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Zone-free timestamps mean UTC; dirty input goes through try_cast, never through silent casts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "sluice", master: str | None = None, database: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, then the caller's; the master stays the cluster's unless one is given."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **settings})
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    if database:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{database}`")
        spark.catalog.setCurrentDatabase(database)
    return spark
