"""Session builder with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive plans with skew-join splitting, Arrow transfer; the rest is the cluster's."""
    builder = SparkSession.builder.appName("peergraph")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
