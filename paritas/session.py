"""Spark session used by tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold results steady whatever the host's locale or zone is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "paritas", cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster pass the session that the cluster made instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
