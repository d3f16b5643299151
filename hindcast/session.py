"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution re-plans every shuffle from measured sizes: it merges small partitions, splits
# skewed ones, and switches a join to broadcast only when the measured side is under the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Noting the Python call site of every column costs several JVM round trips per column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def build_session(app: str = "hindcast", cores: int | None = None) -> SparkSession:
    """A session; `cores` asks for local mode, otherwise the submit command names the master."""
    builder = SparkSession.builder.appName(app)
    settings = dict(SETTINGS)
    if cores:
        builder = builder.master(f"local[{cores}]")
        settings |= LOCAL_SETTINGS | {
            "spark.sql.shuffle.partitions": str(cores),
            "spark.local.dir": os.environ.get("SPARK_LOCAL_DIRS", "/tmp"),
        }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
