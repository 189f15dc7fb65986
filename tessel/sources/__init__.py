"""Where tables come from: Parquet folders, the catalog and the versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that the dialect's semantics rest on; set on a session that this package makes or is given.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "false"}


def session(name: str = "tessel", **conf: str) -> SparkSession:
    """A session with the settings above; AQE plans joins and partitions at run time."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true")
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def pinned(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
