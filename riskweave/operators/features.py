"""Feature engineering: fitted statistics, the ordered feature chain, configurable flags."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import flag, ratio_if_positive, ratio_zero_as_one, without_nan
from riskweave.functions.temporal import local_wall_time, require_utc_wall_time, time_part_columns
from riskweave.operators.quantiles import exact_percentiles, percentile_values
from riskweave.sources.files import require_path
from riskweave.sources.schemas import FITTED_STATISTICS

# --- fixed values: fitted percentiles -----------------------------------------
FITTED_SHARES = {"amount": 0.95, "total_transactions_user": 0.75, "shipping_distance_km": 0.75}

PRODUCTION, EXPLORATORY = "production", "exploratory"


@dataclass(frozen=True)
class FittedStatistics:
    """Percentiles learned from the training rows, with the settings the features need."""

    amount_p95: float
    transactions_p75: int
    distance_p75: float
    zones: Mapping[str, str] = field(default_factory=lambda: dict(fv.COUNTRY_ZONES))
    final_features: Sequence[str] = field(default_factory=lambda: list(fv.FINAL_FEATURES))
    time_column: str = "transaction_time"
    country_column: str = "country"

    @staticmethod
    def fit(train: DataFrame, rounded: bool = True, **settings) -> FittedStatistics:
        found = percentile_values(train, FITTED_SHARES)
        missing = [c for c in FITTED_SHARES if c not in found]
        if missing:
            raise ValueError(f"no values to fit on in {missing}")
        amount, total, distance = (found[c] for c in FITTED_SHARES)
        if rounded:
            amount, total, distance = round(amount, 2), int(total), round(distance, 1)
        return FittedStatistics(amount, total, distance, **settings)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        row = (
            float(self.amount_p95),
            int(self.transactions_p75),
            float(self.distance_p75),
            dict(self.zones),
            list(self.final_features),
            self.time_column,
            self.country_column,
        )
        return spark.createDataFrame([row], FITTED_STATISTICS)

    @staticmethod
    def from_frame(frame: DataFrame) -> FittedStatistics:
        row = frame.select(*FITTED_STATISTICS.fieldNames()).first()
        if row is None:
            raise ValueError("no fitted statistics stored")
        return FittedStatistics(*row)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedStatistics:
        require_path(spark, path)
        return FittedStatistics.from_frame(spark.read.schema(FITTED_STATISTICS).json(path))

    @staticmethod
    def load_or_fit(spark: SparkSession, path: str, train: DataFrame) -> FittedStatistics:
        """The stored statistics; if there are none, fit them on ``train`` and store them."""
        try:
            return FittedStatistics.load(spark, path)
        except FileNotFoundError:
            stats = FittedStatistics.fit(train)
            stats.save(spark, path)
            return stats


def with_local_time(
    frame: DataFrame,
    time_column: str = "transaction_time",
    country_column: str = "country",
    zones: Mapping[str, str] | None = None,
    output: str = "local_time",
) -> DataFrame:
    require_utc_wall_time(frame, time_column)
    if country_column not in frame.columns:
        raise ValueError(f"column {country_column!r} not found")
    zones = fv.COUNTRY_ZONES if zones is None else zones
    return frame.withColumn(output, local_wall_time(F.col(time_column), F.col(country_column), zones))


def with_time_parts(frame: DataFrame, time_column: str, suffix: str = "", **windows) -> DataFrame:
    """Hour, weekday, month, weekend, late-night and business-hours columns; windows may be set freely."""
    return frame.withColumns(time_part_columns(F.col(time_column), suffix, **windows))


def with_amount_features(frame: DataFrame, large_from: float | Column, variant: str = PRODUCTION) -> DataFrame:
    amount, usual = F.col("amount"), F.col("avg_amount_user")
    ratio = ratio_zero_as_one if variant == EXPLORATORY else ratio_if_positive
    return frame.withColumns(
        {
            "amount_deviation": F.abs(amount - usual),
            "amount_vs_avg_ratio": ratio(amount, usual),
            "is_micro_transaction": flag(amount <= 5),
            "is_large_transaction": flag((amount >= large_from) & ~F.isnan(amount)),
        }
    )


def with_behaviour_features(frame: DataFrame, frequent_from: float | Column, variant: str = PRODUCTION) -> DataFrame:
    age, total = F.col("account_age_days"), F.col("total_transactions_user")
    ratio = ratio_zero_as_one if variant == EXPLORATORY else ratio_if_positive
    return frame.withColumns(
        {
            "transaction_velocity": ratio(total, age),
            "is_new_account": flag(age <= 30),
            "is_high_frequency_user": flag(total >= frequent_from),
        }
    )


def with_geographic_features(frame: DataFrame, far_from: float | Column, variant: str = PRODUCTION) -> DataFrame:
    distance = F.col("shipping_distance_km")
    far = distance > far_from if variant == EXPLORATORY else distance >= far_from
    return frame.withColumns(
        {
            # an unknown country on either side counts as a mismatch
            "country_mismatch": F.coalesce(F.col("country") != F.col("bin_country"), F.lit(True)).cast("int"),
            "high_risk_distance": flag(far & ~F.isnan(distance)),
            "zero_distance": flag(distance == 0),
        }
    )


def with_security_features(frame: DataFrame) -> DataFrame:
    score = F.col("avs_match") + F.col("cvv_result") + F.col("three_ds_flag")
    return frame.withColumns(
        {
            "security_score": score,
            "verification_failures": F.lit(3) - score,
            "all_verifications_passed": flag(score == 3),
            "all_verifications_failed": flag(score == 0),
        }
    )


# --- fixed values: risk combinations, each a conjunction of conditions ----------
RISK_COMBINATIONS = [
    {"name": "new_account_with_promo", "conditions": ["is_new_account == 1", "promo_used == 1"]},
    {
        "name": "late_night_micro_transaction",
        "conditions": ["is_late_night_local == 1", "is_micro_transaction == 1"],
    },
    {"name": "high_value_long_distance", "conditions": ["is_large_transaction == 1", "high_risk_distance == 1"]},
    {
        "name": "foreign_card_failed_verification",
        "conditions": ["country_mismatch == 1", "verification_failures > 0"],
    },
    {"name": "new_high_velocity_account", "conditions": ["is_new_account == 1", "is_high_frequency_user == 1"]},
    {
        "name": "triple_risk_combo",
        "conditions": ["is_new_account == 1", "promo_used == 1", "verification_failures > 0"],
    },
]

_COMBINE = {"and": operator.and_, "or": operator.or_}
_COMPARE = {
    ">=": operator.ge,
    ">": operator.gt,
    "<=": operator.le,
    "<": operator.lt,
    "==": operator.eq,
}


def with_condition_flags(frame: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """One 0/1 column per entry ``{name, conditions, operator}``; conditions are SQL expressions."""
    made = {}
    for entry in config:
        combine = _COMBINE.get(entry.get("operator", "and"))
        if combine is None:
            raise ValueError(f"operator must be 'and' or 'or', got {entry['operator']!r}")
        made[entry["name"]] = flag(reduce(combine, [F.expr(c) for c in entry["conditions"]]))
    return frame.withColumns(made) if made else frame


def with_percentile_flags(frame: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """One 0/1 column per entry ``{source, name, operator, percentile}``, cut at this frame's percentile."""
    for entry in config:
        if entry["operator"] not in _COMPARE:
            raise ValueError(f"unsupported comparison {entry['operator']!r}")
    made = {}
    columns = sorted({e["source"] for e in config})
    shares = sorted({e["percentile"] for e in config})
    cuts = {(t.column, t.share): t.low for t in exact_percentiles(frame, columns, shares)} if config else {}
    for entry in config:
        cut = cuts.get((entry["source"], entry["percentile"]))
        made[entry["name"]] = flag(_COMPARE[entry["operator"]](F.col(entry["source"]), F.lit(cut)))
    return frame.withColumns(made) if made else frame


def engineered(frame: DataFrame, stats: FittedStatistics, variant: str = PRODUCTION) -> DataFrame:
    """All derived columns, in order: time, amount, behaviour, geography, security, combinations.

    NaN counts as missing, as NULL does: a flag on a missing value is 0.
    """
    out = with_local_time(without_nan(frame), stats.time_column, stats.country_column, stats.zones)
    out = with_time_parts(out, stats.time_column)
    out = with_time_parts(out, "local_time", "_local")
    out = with_amount_features(out, stats.amount_p95, variant)
    out = with_behaviour_features(out, stats.transactions_p75, variant)
    out = with_geographic_features(out, stats.distance_p75, variant)
    out = with_security_features(out)
    return with_condition_flags(out, RISK_COMBINATIONS)


def explored(frame: DataFrame) -> DataFrame:
    """Exploratory variant: its own zones and edge rules, unrounded percentiles of this very frame."""
    stats = FittedStatistics.fit(frame, rounded=False, zones=fv.EXPLORATORY_ZONES)
    return engineered(frame, stats, EXPLORATORY)


def final_features(frame: DataFrame, stats: FittedStatistics, keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the transformer's order, after any columns to keep."""
    return frame.select(*keep, *stats.final_features)
