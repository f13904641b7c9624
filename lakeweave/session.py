"""The one session that all operators share: UTC, adaptive execution, partitions to match the cores."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "lakeweave", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitting side sets master and memory."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        **conf,
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
