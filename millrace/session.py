"""A session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, ANSI; anything set by the cluster or ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
