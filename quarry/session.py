"""Sessions with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    return b.config(map=base | conf).getOrCreate()
