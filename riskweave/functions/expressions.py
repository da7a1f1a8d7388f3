"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_nan(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes NULL in all (or the named) floating-point columns: both mean a missing value.

    Spark orders NaN above every number, so left alone it would pass every lower bound.
    """
    real = [
        f.name
        for f in frame.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)
    ]
    return frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else frame


def refuse_infinite(values: Mapping[str, float | None], what: str) -> None:
    """Raise if a bound of a column is infinite, where ``what`` has no defined result."""
    bad = sorted(c for c, v in values.items() if v is not None and v in (float("inf"), float("-inf")))
    if bad:
        raise ValueError(f"{what}: infinite values in {bad}")


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def ratio_if_positive(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """numerator / denominator where the denominator is positive, else ``default`` (also for NULL)."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))


def ratio_zero_as_one(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator with a zero denominator read as one."""
    return numerator / F.when(denominator == 0, F.lit(1.0)).otherwise(denominator.cast("double"))


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: Mapping, key: Column, default: Column | None = None) -> Column:
    """Value of a small constant map, NULL (or ``default``) for a key it does not hold."""
    if not mapping:
        return F.lit(None).cast("string") if default is None else default
    found = F.element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, default)


def sigmoid(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def banded(value: Column, lower_bounds: list[tuple[float, str]], lowest: str, strict: bool = False) -> Column:
    """Name of the first band whose lower bound the value reaches; bounds in falling order."""
    out = None
    for bound, name in lower_bounds:
        hit = value > F.lit(bound) if strict else value >= F.lit(bound)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(lowest))


def stacked(rows: list[list[Column]], names: list[str]) -> Column:
    """Explodable array of structs: one struct per entry of ``rows``."""
    return F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows])).alias("row")
