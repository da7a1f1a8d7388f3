"""Spark session settings used by the jobs, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on.  They are defaults for a session this package
# creates; a session handed in by a cluster keeps whatever the cluster set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

# Sizes for a large cluster reading tables of many terabytes: many small shuffle partitions that
# adaptive execution merges, input splits that fit a task, and skewed partitions split early.
LARGE_CLUSTER = {
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def build_session(app: str = "riskweave", master: str | None = None, **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, app: str = "riskweave-local", memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and the bench."""
    spark = build_session(
        app,
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
