"""Intermediate tables on shared storage.

Some operators read one intermediate result several times (bucket boundaries,
bucket totals, then the rows themselves).  Writing it once as Parquet cuts the
lineage, survives the loss of executors and gives later reads exact statistics.
The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get(CONF_KEY, None) or spark.sparkContext.getConf().get(CONF_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CONF_KEY} must name a shared folder when running on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the scratch root; nothing is ever reused or overwritten."""
    return f"{scratch_root(spark)}/riskweave/{label}-{uuid.uuid4().hex}"


def spread(frame: DataFrame) -> DataFrame:
    """Raise a narrow frame to at least one partition per core before repeated heavy work.

    Only inputs too small to fill the cores are shuffled; anything larger is left alone.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


ROWS_PER_PARTITION = 16_384


def few_parts(frame: DataFrame, rows: int) -> DataFrame:
    """Narrow a small input to a partition for every ``ROWS_PER_PARTITION`` rows; a large one stays as it is.

    Iterative learners run a job for every step: on few rows the tasks cost more than the work.
    """
    parts = max(1, -(-rows // ROWS_PER_PARTITION))
    return frame.coalesce(parts) if parts < frame.rdd.getNumPartitions() else frame


def staged(frame: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``frame`` once as Parquet and return a reader over the written table."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)
