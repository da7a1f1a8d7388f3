from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import features as fe
from riskweave.operators.featurizer import TransactionFeaturizer, TransactionFeaturizerModel

STATS = fe.FittedStatistics(180.0, 75, 500.0)


def one(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_noon_utc_in_three_zones(spark):
    frame = spark.createDataFrame([("US",), ("GB",), ("FR",), ("XX",), (None,)], "country string").withColumn(
        "transaction_time", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    )
    hours = one(fe.with_local_time(frame), F.hour("local_time"))
    assert hours == [(7,), (12,), (13,), (12,), (12,)]


def test_summer_time_shifts(spark):
    frame = spark.sql("SELECT 'US' AS country, timestamp_ntz'2024-07-01 12:00:00' AS transaction_time")
    assert one(fe.with_local_time(frame), F.hour("local_time")) == [(8,)]


@pytest.mark.parametrize("kind", ["timestamp", "string"])
def test_time_column_must_be_utc_wall_time(spark, kind):
    frame = spark.sql(f"SELECT 'US' AS country, cast('2024-01-01 12:00:00' AS {kind}) AS transaction_time")
    with pytest.raises(ValueError):
        fe.with_local_time(frame)


def test_missing_columns_are_named(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS transaction_time")
    with pytest.raises(ValueError, match="country"):
        fe.with_local_time(frame)
    with pytest.raises(ValueError, match="when"):
        fe.with_local_time(frame, time_column="when")


def test_zero_average_gives_zero_ratio(spark):
    frame = spark.createDataFrame([(10.0, 0.0), (20.0, 50.0), (5.0, None)], "amount double, avg_amount_user double")
    assert one(fe.with_amount_features(frame, 100.0), "amount_vs_avg_ratio") == [(0.0,), (0.4,), (0.0,)]
    exploratory = fe.with_amount_features(frame, 100.0, fe.EXPLORATORY)
    assert one(exploratory, "amount_vs_avg_ratio")[:2] == [(10.0,), (0.4,)]


def test_zero_age_gives_zero_velocity(spark):
    frame = spark.createDataFrame([(0, 5), (100, 50)], "account_age_days int, total_transactions_user int")
    out = fe.with_behaviour_features(frame, 50)
    assert one(out, "transaction_velocity", "is_new_account", "is_high_frequency_user") == [(0.0, 1, 0), (0.5, 0, 1)]


@pytest.mark.parametrize(
    ("country", "bin_country", "expected"), [("US", "US", 0), ("US", "GB", 1), (None, "US", 1), ("US", None, 1), (None, None, 1)]
)
def test_unknown_country_is_a_mismatch(spark, country, bin_country, expected):
    frame = spark.createDataFrame(
        [(country, bin_country, 0.0)], "country string, bin_country string, shipping_distance_km double"
    )
    assert one(fe.with_geographic_features(frame, 500.0), "country_mismatch") == [(expected,)]


def test_distance_limit_depends_on_variant(spark):
    frame = spark.createDataFrame([("US", "US", 500.0), ("US", "US", None)], "country string, bin_country string, shipping_distance_km double")
    assert one(fe.with_geographic_features(frame, 500.0), "high_risk_distance") == [(1,), (0,)]
    assert one(fe.with_geographic_features(frame, 500.0, fe.EXPLORATORY), "high_risk_distance") == [(0,), (0,)]


@pytest.mark.parametrize(
    ("flags", "expected"), [((1, 1, 1), (3, 0, 1, 0)), ((0, 0, 0), (0, 3, 0, 1)), ((1, 0, 1), (2, 1, 0, 0))]
)
def test_security_features(spark, flags, expected):
    frame = spark.createDataFrame([flags], "avs_match int, cvv_result int, three_ds_flag int")
    out = fe.with_security_features(frame)
    assert one(out, "security_score", "verification_failures", "all_verifications_passed", "all_verifications_failed") == [expected]


def test_risk_combinations(spark):
    schema = (
        "is_new_account int, promo_used int, is_late_night_local int, is_micro_transaction int, is_large_transaction int,"
        "high_risk_distance int, country_mismatch int, verification_failures int, is_high_frequency_user int"
    )
    rows = [(1, 1, 1, 1, 1, 1, 1, 2, 1), (1, 0, 1, 0, 1, 0, 1, 0, 0), (0,) * 9, (1, 1, 0, 1, 0, 1, 0, 0, 1)]
    out = fe.with_condition_flags(spark.createDataFrame(rows, schema), fe.RISK_COMBINATIONS)
    names = [c["name"] for c in fe.RISK_COMBINATIONS]
    assert one(out, *names) == [(1, 1, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0), (0,) * 6, (1, 0, 0, 0, 1, 0)]


def test_condition_flags_reject_unknown_operator(spark):
    with pytest.raises(ValueError, match="xor"):
        fe.with_condition_flags(spark.range(1), [{"name": "a", "conditions": ["id > 0"], "operator": "xor"}])


def test_percentile_flags_reject_unknown_comparison(spark):
    with pytest.raises(ValueError, match="!="):
        fe.with_percentile_flags(spark.range(3), [{"source": "id", "name": "a", "operator": "!=", "percentile": 0.5}])


def test_wrapping_and_plain_windows(spark):
    frame = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-06 00:00:00', timestamp_ntz'2024-01-06 23:00:00', interval 1 hour)) AS t")
    out = fe.with_time_parts(frame, "t", late_night=(22, 2), business=(9, 11))
    night = {r[0] for r in one(out.filter("is_late_night = 1"), "hour")}
    office = {r[0] for r in one(out.filter("is_business_hours = 1"), "hour")}
    assert night == {22, 23, 0, 1, 2}
    assert office == {9, 10, 11}
    assert {r[0] for r in one(out, "day_of_week")} == {5}
    assert {r[0] for r in one(out, "is_weekend")} == {1}


def test_bad_time_yields_zero_flags_not_errors(spark):
    frame = spark.sql("SELECT cast(NULL AS timestamp_ntz) AS t")
    assert one(fe.with_time_parts(frame, "t"), "hour", "is_weekend", "is_late_night", "is_business_hours") == [(None, 0, 0, 0)]


def test_final_projection_is_thirty_columns(raw_rows):
    out = fe.final_features(fe.engineered(raw_rows, STATS), STATS)
    assert out.columns == fv.FINAL_FEATURES
    assert len(out.columns) == 30
    assert sorted(fv.MODEL_COLUMNS) == sorted(fv.FINAL_FEATURES)
    assert set(fv.FEATURE_LABELS) == set(fv.FINAL_FEATURES)


def test_statistics_round_trip(spark, transactions, tmp_path):
    stats = fe.FittedStatistics.fit(transactions)
    stats.save(spark, str(tmp_path / "stats"))
    assert fe.FittedStatistics.load(spark, str(tmp_path / "stats")) == stats


def test_nothing_to_fit_on(transactions):
    with pytest.raises(ValueError, match="amount"):
        fe.FittedStatistics.fit(transactions.filter("false"))


def test_statistics_are_fitted_once(spark, transactions, tmp_path):
    path = str(tmp_path / "stats")
    with pytest.raises(FileNotFoundError):
        fe.FittedStatistics.load(spark, path)
    first = fe.FittedStatistics.load_or_fit(spark, path, transactions)
    assert fe.FittedStatistics.load_or_fit(spark, path, transactions.filter("amount < 10")) == first


def test_featurizer_uses_training_statistics_only(spark, transactions):
    small = transactions.filter("amount < 100")
    model = TransactionFeaturizer().fit(small)
    assert model.statistics().amount_p95 <= 100
    assert model.transform(transactions).columns == fv.FINAL_FEATURES


def test_featurizer_round_trip(spark, transactions, tmp_path):
    model = TransactionFeaturizer(keepColumns=["transaction_id"]).fit(transactions)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = TransactionFeaturizerModel.load(str(tmp_path / "m"))
    assert again.statistics() == model.statistics()
    assert again.transform(transactions).exceptAll(model.transform(transactions)).isEmpty()


def test_unfitted_featurizer_fails(transactions):
    with pytest.raises(ValueError, match="not fitted"):
        TransactionFeaturizerModel().transform(transactions)


def test_fit_transform_equals_fit_then_transform(transactions):
    a = TransactionFeaturizer().fit_transform(transactions)
    b = TransactionFeaturizer().fit(transactions).transform(transactions)
    assert a.exceptAll(b).isEmpty()
