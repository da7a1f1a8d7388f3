"""Event-time expressions.  Event time is a zone-less timestamp holding UTC wall time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.expressions import flag, lookup

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PARTS = ["hour", "day_of_week", "month", "is_weekend", "is_late_night", "is_business_hours"]


def require_utc_wall_time(frame: DataFrame, column: str) -> None:
    """Fail while the plan is built if ``column`` is missing or is not a zone-less timestamp."""
    if column not in frame.columns:
        raise ValueError(f"column {column!r} not found; have {frame.columns}")
    found = frame.schema[column].dataType
    if not isinstance(found, T.TimestampNTZType):
        raise ValueError(f"column {column!r} must be timestamp_ntz holding UTC, found {found.simpleString()}")


def parsed_utc(text: Column) -> Column:
    """Text to UTC wall time; text that is not a valid time becomes NULL."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT)).cast("timestamp_ntz")


def local_wall_time(utc: Column, country: Column, zones: Mapping[str, str]) -> Column:
    """UTC wall time shifted to the country's zone; a country without a zone keeps UTC."""
    return F.convert_timezone(F.lit("UTC"), lookup(zones, country, F.lit("UTC")), utc)


def within_hours(hour: Column, window: tuple[int, int]) -> Column:
    start, end = window
    if start > end:  # the window passes midnight
        return (hour >= start) | (hour <= end)
    return (hour >= start) & (hour <= end)


def time_part_columns(
    time: Column,
    suffix: str = "",
    late_night: tuple[int, int] = (23, 4),
    business: tuple[int, int] = (9, 17),
    weekend_from: int = 5,
) -> dict[str, Column]:
    """The six calendar columns of one timestamp (Monday is day 0)."""
    hour, day = F.hour(time), F.weekday(time)
    return {
        f"hour{suffix}": hour,
        f"day_of_week{suffix}": day,
        f"month{suffix}": F.month(time),
        f"is_weekend{suffix}": flag(day >= weekend_from),
        f"is_late_night{suffix}": flag(within_hours(hour, late_night)),
        f"is_business_hours{suffix}": flag(within_hours(hour, business)),
    }
