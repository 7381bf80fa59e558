"""The Spark session that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "ravelin", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow exchange.

    master and shuffle_partitions are set only where given: on a cluster both
    come from spark-submit. Adaptive execution coalesces small shuffle
    partitions and splits skewed ones, so the partition count may err upwards.
    """
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if master:
        settings["spark.driver.memory"] = settings.get("spark.driver.memory", "4g")
        builder = builder.master(master)
        repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
        if repo not in paths:  # local workers import the package from here
            os.environ["PYTHONPATH"] = ":".join([repo, *paths])
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
