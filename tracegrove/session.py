"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tracegrove", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster's own configuration."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
