"""A session with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tessella", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
