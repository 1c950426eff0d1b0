"""Spark sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and more settings, whose names have _ for each dot."""
    named = {k.replace("_", "."): v for k, v in more.items()}
    builder = SparkSession.builder.config(map=SETTINGS | named)
    return (builder.master(master) if master else builder).getOrCreate()
