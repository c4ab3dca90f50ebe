"""Session construction with the settings that the plans in this package expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "repolens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on. Cluster settings given from outside win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.driver.memory": os.environ.get("REPOLENS_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
