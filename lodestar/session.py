"""Spark sessions with the settings that the checks expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestar", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with ANSI and adaptive execution on and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | settings
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
