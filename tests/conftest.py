from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.session import local_session
from riskweave.sources import warehouse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="riskweave-tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def transactions(spark):
    return warehouse.transactions(spark, SF).persist()


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Ten hand-made transactions, two hours apart."""
    rows = spark.range(10).select(
        F.col("id").alias("transaction_id"),
        F.lit(1).cast("bigint").alias("user_id"),
        (F.lit("2024-01-15 10:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(id * 2 as int), 0, 0)")).alias(
            "transaction_time"
        ),
        (F.col("id") * 20 + 4.0).alias("amount"),
        F.lit("grocery").alias("merchant_category"),
        F.element_at(F.array(*[F.lit(c) for c in ["US", "GB", "FR", "JP", "XX"]]), (F.col("id") % 5 + 1).cast("int")).alias(
            "country"
        ),
        F.lit("US").alias("bin_country"),
        (F.col("id") * 100.0).alias("shipping_distance_km"),
        F.when(F.col("id") % 2 == 0, "web").otherwise("app").alias("channel"),
        (F.col("id") % 2).cast("int").alias("promo_used"),
        F.lit(1).alias("avs_match"),
        (F.col("id") % 3 == 0).cast("int").alias("cvv_result"),
        F.lit(0).alias("three_ds_flag"),
        (F.col("id") * 10).cast("int").alias("account_age_days"),
        (F.col("id") * 15).cast("int").alias("total_transactions_user"),
        F.lit(50.0).alias("avg_amount_user"),
    )
    return rows.persist()
