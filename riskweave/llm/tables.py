"""Reading the corpus tables, folds, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.scratch import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key gives -1, which no fold uses."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def fresh_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``frame`` has that name in any case."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_row_ids(frame: DataFrame, label: str, name: str = "row_id") -> DataFrame:
    """Write ``frame`` once with a number for each row, so that every later read sees the same numbers."""
    return staged(frame.withColumn(name, F.monotonically_increasing_id()), label)


def labelled_sample(
    labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, key: str = "doc_id"
) -> DataFrame:
    """At most ``per_class`` keys for each value of a 0/1 label, outside the held-out fold.

    Rows are taken in the order of a hash of the key, so the choice does not depend on the partitions.  Rows with a
    null key or label are left out; of contradicting rows for one key the larger label counts.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(key, folds) != held_out))
        .groupBy(F.col(key).alias(key))
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = [F.xxhash64(key), F.col(key)]
    parts = [known.filter(F.col("label") == value).orderBy(*order).limit(per_class) for value in (0, 1)]
    return parts[0].unionByName(parts[1])
