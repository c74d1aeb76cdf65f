"""A session with the settings that the joins rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """`settings` have underscores for dots. Partition counts and memory are the cluster's to set."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
