"""Session settings used by the tests and the benchmark.

On a cluster the session comes from the submitter; nothing here is required
by the library, which reads every setting it needs from the live session.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "stratastats", cpus: int | str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
