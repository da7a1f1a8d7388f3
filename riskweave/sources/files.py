"""CSV sources and sinks for transactions and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources.schemas import TRANSACTION

CSV_TIME = "yyyy-MM-dd HH:mm:ss"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path (or glob) matches something on its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path))


def require_path(spark: SparkSession, path: str) -> None:
    """Raise FileNotFoundError unless the path (or glob) matches something on its file system."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and an explicit schema; columns are matched by the header's order."""
    require_path(spark, path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", CSV_TIME)
        .csv(path)
    )


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    return read_csv(spark, path, schema)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.option("header", True).option("timestampNTZFormat", CSV_TIME).csv(path)


def transaction_report(frame: DataFrame, label: str = "is_fraud") -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("positive_rate"))


def shape_report(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(frame.columns)))
