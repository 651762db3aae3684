"""Spark session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from turnwise.streaming.streams import STATE_STORE


def session(app: str = "turnwise", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides (dots as __)."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    settings |= STATE_STORE
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
