"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow; shuffle partitions follow the cores of a local master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        cores = os.cpu_count() or 8
        builder = builder.config("spark.sql.shuffle.partitions", str(max(8, cores)))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
