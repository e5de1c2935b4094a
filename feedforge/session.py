"""Session settings that every operator of the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "feedforge", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster, submit with the same SQL settings instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints that nothing refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # plans of many stages are not written out in full after each of them
        "spark.sql.maxPlanStringLength": "50000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
