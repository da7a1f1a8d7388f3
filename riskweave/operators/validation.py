"""Validation and normalisation of incoming transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import stacked
from riskweave.functions.temporal import parsed_utc

# --- fixed values: value rules of a scoring request ---------------------------
NON_NEGATIVE = [
    "user_id",
    "account_age_days",
    "total_transactions_user",
    "avg_amount_user",
    "amount",
    "shipping_distance_km",
]
TWO_LETTER = ["country", "bin_country"]
CHANNEL_PATTERN = r"\A(web|app)\z"
TIME_PATTERN = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"


def with_utc_time(frame: DataFrame, column: str = "transaction_time") -> DataFrame:
    """Parse text event time as UTC; text that is no valid time becomes NULL."""
    return frame.withColumn(column, parsed_utc(F.col(column)))


def rule_violations(columns: Sequence[str] = tuple(fv.REQUEST_COLUMNS)) -> Column:
    """Names of the broken rules of a row, in column order; empty for a valid row."""
    checks: list[Column] = []

    def broken(when: Column, rule: str) -> None:
        checks.append(F.when(F.coalesce(when, F.lit(False)), F.lit(rule)))

    for c in columns:
        col = F.col(c)
        broken(col.isNull(), f"{c}:required")
        if c in NON_NEGATIVE:
            broken(col < 0, f"{c}:negative")
            broken(F.isnan(col.cast("double")), f"{c}:not_a_number")
        if c in fv.RAW_FLAGS:
            broken(~col.isin(0, 1), f"{c}:not_flag")
        if c in TWO_LETTER:
            broken(F.length(col) != 2, f"{c}:not_two_letters")
        if c == "channel":
            broken(~col.rlike(CHANNEL_PATTERN), f"{c}:unknown")
        if c == "transaction_time":
            broken(~col.rlike(TIME_PATTERN), f"{c}:format")
    return F.array_compact(F.array(*checks))


def checked(frame: DataFrame) -> DataFrame:
    """The frame with an ``errors`` array."""
    return frame.withColumn("errors", rule_violations())


def valid_rows(checked_frame: DataFrame) -> DataFrame:
    return checked_frame.filter(F.size("errors") == 0).drop("errors")


def rejected_rows(checked_frame: DataFrame) -> DataFrame:
    return checked_frame.filter(F.size("errors") > 0)


def with_upper_countries(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.upper(c) for c in TWO_LETTER})


def grain_check(frame: DataFrame, keys: Sequence[str] = ("transaction_id", "user_id")) -> DataFrame:
    """Row count, distinct key count and whether the keys identify a row.

    Two levels: count per key, then totals, so no task ever holds all keys.
    """
    per_key = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    ).withColumn("is_unique", (F.col("n_rows") == F.col("n_keys")).cast("int"))


def column_audit(frame: DataFrame) -> DataFrame:
    """One row per column: type, filled count and null count, from one pass."""
    names = frame.columns
    counted = frame.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in names])
    rows = [
        [F.lit(c), F.lit(frame.schema[c].dataType.simpleString()), F.col(c), F.col("_rows") - F.col(c)]
        for c in names
    ]
    return counted.select(stacked(rows, ["column_name", "data_type", "n_filled", "n_null"])).select("row.*")
