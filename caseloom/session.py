"""A SparkSession with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew handling on; anything in ``conf`` (dots as ``__``) on top."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
