"""The session that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomwork", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` overrides (with ``__`` for dots)."""
    b = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
