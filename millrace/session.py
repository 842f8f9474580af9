"""Session settings the engine relies on; everything else is left to the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE and skew-join handling; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = cpus or os.cpu_count() or 4
    return session(
        master=f"local[{n}]",
        **{"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"},
    )
