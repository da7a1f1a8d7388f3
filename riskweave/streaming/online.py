"""Stateless scoring of a stream of raw transactions.

Every micro-batch runs the batch functions with statistics, model and thresholds that were
fitted before; nothing is refitted inside the stream and no state is kept, so there is no
watermark.  Each batch writes its own folder and overwrites it when replayed, which makes
a restarted batch leave the same result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators import scoring, validation
from riskweave.operators.features import FittedStatistics
from riskweave.plans.scoring_job import Scorer, with_features


FEWEST_FILES = 4  # files of a micro-batch on few cores


def files_at_once(spark: SparkSession) -> int:
    """Files of a micro-batch that give each core one; a fixed number would leave the cores beyond it idle in every batch."""
    return max(FEWEST_FILES, spark.sparkContext.defaultParallelism)


def request_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """Stream over files of raw requests with an explicit schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_scoring(
    requests: DataFrame,
    stats: FittedStatistics,
    score: Scorer,
    thresholds: Mapping[str, float],
    accepted_path: str,
    rejected_path: str,
    checkpoint_path: str,
    strategy: str = "target_performance",
    extra: tuple[str, ...] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Score a request stream; valid rows go to one sink, rows with errors to another.

    ``score`` adds a ``probability`` column to engineered rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # two sinks read the batch; without this its files would be parsed twice
        checked = validation.checked(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = score(with_features(validation.valid_rows(checked), stats))
            records = scoring.output_records(scoring.decided(scored, thresholds, strategy), *extra)
            records.write.mode("overwrite").parquet(f"{accepted_path}/batch_id={batch_id}")
            rejected = validation.rejected_rows(checked)
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()
