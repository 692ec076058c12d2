"""Session construction for scripts and tests; library code always takes a session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "quillon", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
