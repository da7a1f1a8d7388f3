"""NaN, infinite values and NULL labels: one rule in all operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.operators import features, metrics, profiling, splits, validation
from riskweave.operators.curves import score_counts
from riskweave.operators.features import FittedStatistics

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(float(i), 2.0 * i + i % 3, i % 2) for i in range(20)] + [(NAN, NAN, 1), (None, 5.0, 0)]
    return spark.createDataFrame(rows, "x double, y double, is_fraud int")


def test_flags_on_missing_values_are_zero(spark, transactions):
    stats = FittedStatistics.fit(transactions)
    bad = transactions.limit(1).withColumns({"amount": F.lit(NAN), "shipping_distance_km": F.lit(NAN)})
    row = features.engineered(bad, stats).first()
    assert (row.is_large_transaction, row.high_risk_distance, row.high_value_long_distance) == (0, 0, 0)


def test_validation_refuses_nan_and_trailing_newlines(spark):
    rows = [(NAN, "web", "2024-01-01 10:00:00"), (1.0, "web\n", "2024-01-01 10:00:00"), (1.0, "app", "2024-01-01 10:00:00\n"), (1.0, "app", "2024-01-01 10:00:00")]
    frame = spark.createDataFrame(rows, "amount double, channel string, transaction_time string")
    errors = [r.e for r in frame.select(validation.rule_violations(frame.columns).alias("e")).collect()]
    assert errors == [["amount:not_a_number"], ["channel:unknown"], ["transaction_time:format"], []]


def test_profiles_leave_nan_out(numbers):
    row = profiling.describe(numbers, ["x"]).first()
    assert (row["count"], row["max"], row["mean"]) == (20, 19.0, 9.5)
    assert all(r.correlation == r.correlation for r in profiling.label_correlations(numbers, ["x", "y"]).collect())
    assert all(r.vif is not None for r in profiling.inflation_factors(numbers, ["x", "y"]).collect())


def test_histogram_of_missing_and_infinite_columns(spark, numbers):
    frame = numbers.withColumn("z", F.lit(None).cast("double"))
    rows = profiling.histogram(frame, ["x", "z"], bins=4).collect()
    assert sum(r.n for r in rows if r.feature == "x") == 20
    assert [(r.n, r.bin) for r in rows if r.feature == "z"] == [(0, None)]
    with pytest.raises(ValueError, match="infinite"):
        profiling.histogram(numbers.withColumn("x", F.lit(float("inf"))), ["x"])


@pytest.mark.parametrize("row", [(1, NAN), (1, None), (None, 0.5)])
def test_metrics_refuse_missing_scores_and_labels(spark, row):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.1), row], "label int, score double")
    for work in (score_counts, metrics.confusion):
        with pytest.raises(Exception, match="missing value"):
            work(scored).collect()


def test_null_labels_are_refused(spark):
    frame = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, None)], "transaction_id long, x double, is_fraud int")
    with pytest.raises(ValueError, match="NULL"):
        splits.train_val_test(frame)
    with pytest.raises(ValueError, match="NULL"):
        splits.stratified_folds(frame)
    with pytest.raises(ValueError, match="NULL"):
        profiling.box_statistics(frame, ["x"])
