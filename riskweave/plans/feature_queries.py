"""Queries: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import features as fe
from riskweave.operators import splits
from riskweave.operators.importance import display_name
from riskweave.operators.featurizer import TransactionFeaturizer
from riskweave.plans.data_queries import RANKED
from riskweave.plans.registry import query, rounded, tx
from riskweave.sources import warehouse
from riskweave.sources.scratch import scratch_path


def zone_map_sql(zones: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{c}': '{z}'" for c, z in zones.items()) + "}"


def local_sql(zones: dict[str, str]) -> str:
    return (
        "(transaction_time AT TIME ZONE 'UTC') AT TIME ZONE "
        f"coalesce({zone_map_sql(zones)}[country], 'UTC')"
    )


def time_parts_sql(t: str, suffix: str, night="h >= 23 OR h <= 4", business="h BETWEEN 9 AND 17", weekend=5) -> str:
    """The six calendar columns of timestamp expression ``t``."""
    h, d = f"hour({t})", f"(isodow({t}) - 1)"
    return (
        f"CAST({h} AS INTEGER) AS hour{suffix}, CAST({d} AS INTEGER) AS day_of_week{suffix}, "
        f"CAST(month({t}) AS INTEGER) AS month{suffix}, CAST({d} >= {weekend} AS INTEGER) AS is_weekend{suffix}, "
        f"CAST({night.replace('h ', h + ' ')} AS INTEGER) AS is_late_night{suffix}, "
        f"CAST({business.replace('h ', h + ' ')} AS INTEGER) AS is_business_hours{suffix}"
    )


AMOUNT = """abs(amount - avg_amount_user) AS amount_deviation,
  CASE WHEN avg_amount_user > 0 THEN amount / avg_amount_user ELSE 0 END AS amount_vs_avg_ratio,
  CAST(amount <= 5 AS INTEGER) AS is_micro_transaction, CAST(amount >= p_amount AS INTEGER) AS is_large_transaction"""
BEHAVIOUR = """CASE WHEN account_age_days > 0 THEN total_transactions_user / account_age_days::DOUBLE ELSE 0 END
    AS transaction_velocity, CAST(account_age_days <= 30 AS INTEGER) AS is_new_account,
  CAST(total_transactions_user >= p_total AS INTEGER) AS is_high_frequency_user"""
GEOGRAPHY = """CAST(country <> bin_country AS INTEGER) AS country_mismatch,
  CAST(shipping_distance_km >= p_distance AS INTEGER) AS high_risk_distance,
  CAST(shipping_distance_km = 0 AS INTEGER) AS zero_distance"""
SECURITY = """avs_match + cvv_result + three_ds_flag AS security_score,
  3 - (avs_match + cvv_result + three_ds_flag) AS verification_failures,
  CAST(avs_match + cvv_result + three_ds_flag = 3 AS INTEGER) AS all_verifications_passed,
  CAST(avs_match + cvv_result + three_ds_flag = 0 AS INTEGER) AS all_verifications_failed"""
COMBOS = """CAST(is_new_account = 1 AND promo_used = 1 AS INTEGER) AS new_account_with_promo,
  CAST(is_late_night_local = 1 AND is_micro_transaction = 1 AS INTEGER) AS late_night_micro_transaction,
  CAST(is_large_transaction = 1 AND high_risk_distance = 1 AS INTEGER) AS high_value_long_distance,
  CAST(country_mismatch = 1 AND verification_failures > 0 AS INTEGER) AS foreign_card_failed_verification,
  CAST(is_new_account = 1 AND is_high_frequency_user = 1 AS INTEGER) AS new_high_velocity_account,
  CAST(is_new_account = 1 AND promo_used = 1 AND verification_failures > 0 AS INTEGER) AS triple_risk_combo"""

FIT = """SELECT round(quantile_cont(amount, 0.95), 2) AS p_amount,
  CAST(trunc(quantile_cont(total_transactions_user, 0.75)) AS INTEGER) AS p_total,
  round(quantile_cont(shipping_distance_km, 0.75), 1) AS p_distance"""


def featured_sql(fit_from: str = "tx") -> str:
    """CTE ``featured`` with every derived column, percentiles fitted on ``fit_from``."""
    return f""", fit AS ({FIT} FROM {fit_from}),
    zoned AS (SELECT *, {local_sql(fv.COUNTRY_ZONES)} AS local_time FROM tx, fit),
    simple AS (SELECT *, {time_parts_sql("transaction_time", "")}, {time_parts_sql("local_time", "_local")},
       {AMOUNT}, {BEHAVIOUR}, {GEOGRAPHY}, {SECURITY} FROM zoned),
    featured AS (SELECT *, {COMBOS} FROM simple)
    """


DERIVED = [
    "local_time",
    *[f"{c}{s}" for s in ("", "_local") for c in
      ("hour", "day_of_week", "month", "is_weekend", "is_late_night", "is_business_hours")],
    "amount_deviation",
    "amount_vs_avg_ratio",
    "is_micro_transaction",
    "is_large_transaction",
    "transaction_velocity",
    "is_new_account",
    "is_high_frequency_user",
    "country_mismatch",
    "high_risk_distance",
    "zero_distance",
    "security_score",
    "verification_failures",
    "all_verifications_passed",
    "all_verifications_failed",
    *[c["name"] for c in fe.RISK_COMBINATIONS],
]
FINAL_SQL = ", ".join(fv.FINAL_FEATURES)


def base(spark, sf):
    return warehouse.transactions(spark, sf)


@query("f1_local_time", tx(f"SELECT transaction_id, country, {local_sql(fv.COUNTRY_ZONES)} AS local_time FROM tx"))
def f1(spark, sf):
    return fe.with_local_time(base(spark, sf)).select("transaction_id", "country", "local_time")


CUSTOM_ZONES = {"NL": "Europe/Amsterdam", "TR": "Europe/Istanbul", "AU": "Australia/Perth"}


@query("f2_local_time_custom", tx(f"SELECT transaction_id, {local_sql(CUSTOM_ZONES)} AS wall_time FROM tx"))
def f2(spark, sf):
    out = fe.with_local_time(base(spark, sf), zones=CUSTOM_ZONES, output="wall_time")
    return out.select("transaction_id", "wall_time")


@query(
    "f3_time_parts",
    tx(f""", zoned AS (SELECT *, {local_sql(fv.COUNTRY_ZONES)} AS local_time FROM tx)
    SELECT transaction_id, {time_parts_sql("transaction_time", "")}, {time_parts_sql("local_time", "_local")} FROM zoned"""),
)
def f3(spark, sf):
    out = fe.with_time_parts(fe.with_local_time(base(spark, sf)), "transaction_time")
    out = fe.with_time_parts(out, "local_time", "_local")
    return out.select("transaction_id", *DERIVED[1:13])


@query(
    "f4_time_parts_custom_windows",
    tx(
        "SELECT transaction_id, "
        + time_parts_sql("transaction_time", "_a", "h >= 22 OR h <= 5", "h BETWEEN 8 AND 18", 4)
        + ", "
        + time_parts_sql("transaction_time", "_b", "h >= 1 AND h <= 5", "h >= 20 OR h <= 3", 5)
        + " FROM tx"
    ),
)
def f4(spark, sf):
    out = fe.with_time_parts(
        base(spark, sf), "transaction_time", "_a", late_night=(22, 5), business=(8, 18), weekend_from=4
    )
    out = fe.with_time_parts(out, "transaction_time", "_b", late_night=(1, 5), business=(20, 3))
    return out.select("transaction_id", *[c for c in out.columns if c.endswith(("_a", "_b"))])


@query("f5_amount_features", tx(f", fit AS ({FIT} FROM tx) SELECT transaction_id, {AMOUNT} FROM tx, fit"))
def f5(spark, sf):
    frame = base(spark, sf)
    out = fe.with_amount_features(frame, fe.FittedStatistics.fit(frame).amount_p95)
    return out.select("transaction_id", *DERIVED[13:17])


@query("f6_behaviour_features", tx(f", fit AS ({FIT} FROM tx) SELECT transaction_id, {BEHAVIOUR} FROM tx, fit"))
def f6(spark, sf):
    frame = base(spark, sf)
    out = fe.with_behaviour_features(frame, fe.FittedStatistics.fit(frame).transactions_p75)
    return out.select("transaction_id", *DERIVED[17:20])


@query("f7_geographic_features", tx(f", fit AS ({FIT} FROM tx) SELECT transaction_id, {GEOGRAPHY} FROM tx, fit"))
def f7(spark, sf):
    frame = base(spark, sf)
    out = fe.with_geographic_features(frame, fe.FittedStatistics.fit(frame).distance_p75)
    return out.select("transaction_id", *DERIVED[20:23])


@query(
    "f8_security_and_combinations",
    tx(featured_sql() + "SELECT transaction_id, " + ", ".join(DERIVED[23:]) + " FROM featured"),
)
def f8(spark, sf):
    frame = base(spark, sf)
    return fe.engineered(frame, fe.FittedStatistics.fit(frame)).select("transaction_id", *DERIVED[23:])


@query(
    "f9_condition_flags",
    tx("""SELECT transaction_id, CAST(amount > 500 AND channel = 'web' AS INTEGER) AS big_web,
    CAST(promo_used = 1 OR avs_match = 0 OR country <> bin_country AS INTEGER) AS any_signal FROM tx"""),
)
def f9(spark, sf):
    config = [
        {"name": "big_web", "conditions": ["amount > 500", "channel == 'web'"]},
        {
            "name": "any_signal",
            "conditions": ["promo_used == 1", "avs_match == 0", "country != bin_country"],
            "operator": "or",
        },
    ]
    return fe.with_condition_flags(base(spark, sf), config).select("transaction_id", "big_web", "any_signal")


@query(
    "f10_percentile_flags",
    tx(""", q AS (SELECT quantile_cont(amount, 0.9) AS a90, quantile_cont(amount, 0.1) AS a10,
      quantile_cont(shipping_distance_km, 0.75) AS d75, quantile_cont(account_age_days, 0.25) AS g25,
      quantile_cont(total_transactions_user, 0.5) AS t50 FROM tx)
    SELECT transaction_id, CAST(amount >= a90 AS INTEGER) AS top_amount, CAST(amount < a10 AS INTEGER) AS low_amount,
      CAST(shipping_distance_km > d75 AS INTEGER) AS far, CAST(account_age_days <= g25 AS INTEGER) AS young,
      CAST(total_transactions_user = t50 AS INTEGER) AS usual FROM tx, q"""),
)
def f10(spark, sf):
    config = [
        {"source": "amount", "name": "top_amount", "operator": ">=", "percentile": 0.9},
        {"source": "amount", "name": "low_amount", "operator": "<", "percentile": 0.1},
        {"source": "shipping_distance_km", "name": "far", "operator": ">", "percentile": 0.75},
        {"source": "account_age_days", "name": "young", "operator": "<=", "percentile": 0.25},
        {"source": "total_transactions_user", "name": "usual", "operator": "==", "percentile": 0.5},
    ]
    out = fe.with_percentile_flags(base(spark, sf), config)
    return out.select("transaction_id", *[c["name"] for c in config])


@query(
    "f11_fitted_statistics",
    tx(f", fit AS ({FIT} FROM tx) SELECT p_amount AS amount_p95, p_total AS transactions_p75, "
       "p_distance AS distance_p75 FROM fit"),
)
def f11(spark, sf):
    stats = fe.FittedStatistics.fit(base(spark, sf))
    return stats.to_frame(spark).select("amount_p95", "transactions_p75", "distance_p75")


@query(
    "sc4_statistics_artifact",
    tx(
        f", fit AS ({FIT} FROM tx) SELECT p_amount AS amount_p95, p_total AS transactions_p75, "
        f"p_distance AS distance_p75, 10 AS n_zones, 30 AS n_features, 'transaction_time' AS time_column FROM fit"
    ),
)
def sc4(spark, sf):
    path = scratch_path(spark, "statistics")
    fe.FittedStatistics.fit(base(spark, sf)).save(spark, path)
    return (
        fe.FittedStatistics.load(spark, path)
        .to_frame(spark)
        .select(
            "amount_p95",
            "transactions_p75",
            "distance_p75",
            F.size("zones").alias("n_zones"),
            F.size("final_features").alias("n_features"),
            "time_column",
        )
    )


@query(
    "f12_featurizer_fit_on_train",
    tx(
        RANKED
        + ", train AS (SELECT tx.* FROM tx JOIN parts ON tx.transaction_id = parts.transaction_id WHERE split = 'train')"
        + featured_sql("train")
        + f"SELECT transaction_id, {FINAL_SQL} FROM featured"
    ),
)
def f12(spark, sf):
    frame = splits.train_val_test(base(spark, sf))
    model = TransactionFeaturizer(keepColumns=["transaction_id"]).fit(frame.filter("split = 'train'"))
    return model.transform(frame)


@query(
    "f13_engineered_chain",
    tx(featured_sql() + "SELECT transaction_id, " + ", ".join(DERIVED) + " FROM featured"),
)
def f13(spark, sf):
    frame = base(spark, sf)
    return fe.engineered(frame, fe.FittedStatistics.fit(frame)).select("transaction_id", *DERIVED)


@query("f14_final_features", tx(featured_sql() + f"SELECT transaction_id, {FINAL_SQL} FROM featured"))
def f14(spark, sf):
    frame = base(spark, sf)
    stats = fe.FittedStatistics.fit(frame)
    return fe.final_features(fe.engineered(frame, stats), stats, ["transaction_id"])


@query(
    "f15_exploratory_features",
    tx(f""", q AS (SELECT quantile_cont(amount, 0.95) AS pa, quantile_cont(total_transactions_user, 0.75) AS pt,
        quantile_cont(shipping_distance_km, 0.75) AS pd FROM tx)
    SELECT transaction_id, {local_sql(fv.EXPLORATORY_ZONES)} AS local_time,
      amount / CASE WHEN avg_amount_user = 0 THEN 1 ELSE avg_amount_user END AS amount_vs_avg_ratio,
      total_transactions_user / CASE WHEN account_age_days = 0 THEN 1 ELSE account_age_days END::DOUBLE
        AS transaction_velocity,
      CAST(amount >= pa AS INTEGER) AS is_large_transaction,
      CAST(total_transactions_user >= pt AS INTEGER) AS is_high_frequency_user,
      CAST(shipping_distance_km > pd AS INTEGER) AS high_risk_distance FROM tx, q"""),
)
def f15(spark, sf):
    return fe.explored(base(spark, sf)).select(
        "transaction_id",
        "local_time",
        "amount_vs_avg_ratio",
        "transaction_velocity",
        "is_large_transaction",
        "is_high_frequency_user",
        "high_risk_distance",
    )


NUMERIC = [c for c in fv.MODEL_COLUMNS if c not in fv.CATEGORICAL_FEATURES]


@query(
    "x13_display_names",
    tx(
        featured_sql()
        + "SELECT feature, label, round(avg(v), 6) AS mean_value FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{fv.FEATURE_LABELS.get(c, c)}' AS label, CAST({c} AS DOUBLE) AS v FROM featured"
            for c in NUMERIC
        )
        + ") GROUP BY feature, label"
    ),
)
def x13(spark, sf):
    frame = base(spark, sf)
    values = fe.engineered(frame, fe.FittedStatistics.fit(frame)).select(
        *[F.col(c).cast("double").alias(c) for c in NUMERIC]
    )
    long = values.unpivot([], NUMERIC, "feature", "value").groupBy("feature").agg(F.avg("value").alias("mean_value"))
    return rounded(long.withColumn("label", display_name(F.col("feature"))))
