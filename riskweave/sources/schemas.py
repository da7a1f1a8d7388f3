"""Explicit schemas; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("total_transactions_user", T.IntegerType()),
        T.StructField("avg_amount_user", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("bin_country", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("promo_used", T.IntegerType()),
        T.StructField("avs_match", T.IntegerType()),
        T.StructField("cvv_result", T.IntegerType()),
        T.StructField("three_ds_flag", T.IntegerType()),
        T.StructField("shipping_distance_km", T.DoubleType()),
        T.StructField("transaction_time", T.TimestampNTZType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)


def request_schema(*extra: T.StructField) -> T.StructType:
    """Transactions as they arrive for scoring: time is still text, there is no label."""
    fields = [
        T.StructField(f.name, T.StringType() if f.name == "transaction_time" else f.dataType)
        for f in TRANSACTION.fields
        if f.name != "is_fraud"
    ]
    return T.StructType(fields + list(extra))


# One value per run, candidate, fold, split and metric.
CANDIDATE_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("candidate_id", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fold", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

FITTED_STATISTICS = T.StructType(
    [
        T.StructField("amount_p95", T.DoubleType()),
        T.StructField("transactions_p75", T.IntegerType()),
        T.StructField("distance_p75", T.DoubleType()),
        T.StructField("zones", T.MapType(T.StringType(), T.StringType())),
        T.StructField("final_features", T.ArrayType(T.StringType())),
        T.StructField("time_column", T.StringType()),
        T.StructField("country_column", T.StringType()),
    ]
)
