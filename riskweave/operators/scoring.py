"""Decisions, risk bands and output records for scored transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import banded

MODEL_VERSION = "1.0"


def strategy_thresholds(strategies: DataFrame) -> dict[str, float]:
    """The named thresholds; a strategy table has one row per strategy."""
    return {r["strategy"]: r["threshold"] for r in strategies.select("strategy", "threshold").collect()}


def risk_band(probability: Column, bands: Mapping[str, float] | None = None) -> Column:
    bands = fv.RISK_BANDS if bands is None else bands
    return banded(probability, [(bands["medium"], "high"), (bands["low"], "medium")], "low")


def decided(
    scored: DataFrame,
    thresholds: Mapping[str, float],
    strategy: str = "target_performance",
    probability: str = "probability",
    bands: Mapping[str, float] | None = None,
) -> DataFrame:
    """Add decision, band, strategy, threshold and model version for one strategy."""
    if strategy not in thresholds:
        raise ValueError(f"unknown strategy {strategy!r}, have {sorted(thresholds)}")
    limit = F.lit(float(thresholds[strategy]))
    p = F.col(probability)
    return scored.withColumns(
        {
            "is_fraud_predicted": (p >= limit).cast("int"),
            "risk_level": F.when(p.isNotNull(), risk_band(p, bands)),
            "threshold_used": F.lit(strategy),
            "threshold_value": limit,
            "model_version": F.lit(MODEL_VERSION),
        }
    )


def decided_by_all(
    scored: DataFrame, thresholds: Mapping[str, float], probability: str = "probability"
) -> DataFrame:
    """One row per transaction and strategy, in one narrow pass."""
    cells = F.array(
        *[F.struct(F.lit(s).alias("strategy"), F.lit(float(t)).alias("threshold")) for s, t in thresholds.items()]
    )
    return scored.withColumn("s", F.explode(cells)).select(
        *scored.columns,
        F.col("s.strategy").alias("threshold_used"),
        F.col("s.threshold").alias("threshold_value"),
        (F.col(probability) >= F.col("s.threshold")).cast("int").alias("is_fraud_predicted"),
    )


OUTPUT = [
    "transaction_id",
    "is_fraud_predicted",
    "probability",
    "risk_level",
    "threshold_used",
    "threshold_value",
    "model_version",
]


def output_records(decided_frame: DataFrame, *extra: str) -> DataFrame:
    return decided_frame.select(*OUTPUT, *extra)
