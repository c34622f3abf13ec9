"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(name: str = "eventloom", **extra: str) -> SparkSession:
    """A session with UTC, adaptive execution and last-wins map keys."""
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **extra}).getOrCreate()
