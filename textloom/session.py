"""Session factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "textloom", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow.

    ``master`` is for local runs; on a cluster it comes from spark-submit.
    Shuffle partitions follow the cores there, and the cluster's setting
    elsewhere: adaptive execution merges small ones.
    """
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        cores = os.cpu_count() or 8
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(min(cores, 16))).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
