"""Exact interpolated percentiles without holding a column in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer.
Here a bounded sketch first brackets each wanted rank; one more pass counts the rows
below the bracket and checks that the rank lies inside; only the rows inside the
brackets (a few per ten thousand) are then grouped by value and ranked exactly.
Where the first pass has counted few enough values, the built-in one is used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.running import running_totals
from riskweave.sources.scratch import staged

ACCURACY = 10_000
SMALL = 1_000_000  # values per group and column that the built-in percentile may hold


@dataclass
class Target:
    """One wanted percentile of one column within one group."""

    column: str
    group: object
    share: float
    count: int
    low: float
    high: float
    below: int = 0

    @property
    def position(self) -> float:
        exact = self.share * (self.count - 1)
        nearest = round(exact)
        # a share that stands for one rank must not become an interpolation by rounding error
        return float(nearest) if abs(exact - nearest) <= 4e-16 * max(exact, 1.0) else exact


def _doubles(frame: DataFrame, columns: Sequence[str], by: str | None) -> DataFrame:
    keys = [F.col(by).alias("_by")] if by else [F.lit(0).alias("_by")]
    picked = []
    for c in columns:
        value = F.col(c).cast("double")
        picked.append(F.when(~F.isnan(value), value).alias(c))
    return frame.select(*keys, *picked)


def _sketch(data: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> list:
    """Count, ends and bracketing sketch values of every column: one row per group."""
    margin = 2.0 / ACCURACY
    asked = [max(0.0, s - margin) for s in shares] + [min(1.0, s + margin) for s in shares]
    return (
        data.groupBy("_by")
        .agg(
            *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
            *[F.min(c).alias(f"min_{i}") for i, c in enumerate(columns)],
            *[F.max(c).alias(f"max_{i}") for i, c in enumerate(columns)],
            *[F.percentile_approx(c, asked, ACCURACY).alias(f"q_{i}") for i, c in enumerate(columns)],
        )
        .collect()
    )


def _built_in(data: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> list[Target]:
    rows = (
        data.groupBy("_by")
        .agg(
            *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
            *[F.percentile(c, list(shares)).alias(f"p_{i}") for i, c in enumerate(columns)],
        )
        .collect()
    )
    return [
        Target(c, row["_by"], s, row[f"n_{i}"], row[f"p_{i}"][j], row[f"p_{i}"][j])
        for row in rows
        for i, c in enumerate(columns)
        if row[f"n_{i}"]
        for j, s in enumerate(shares)
    ]


def _brackets(data: DataFrame, first: list, columns: Sequence[str], shares: Sequence[float]) -> list[Target]:
    """Bracket every target by the sketch, then count the rows below each bracket."""
    margin = 2.0 / ACCURACY
    targets = []
    for row in first:
        for i, c in enumerate(columns):
            if not row[f"n_{i}"]:
                continue
            for j, s in enumerate(shares):
                low, high = row[f"q_{i}"][j], row[f"q_{i}"][len(shares) + j]
                low = row[f"min_{i}"] if s <= margin else low
                high = row[f"max_{i}"] if s >= 1 - margin else high
                targets.append(Target(c, row["_by"], s, row[f"n_{i}"], low, high))

    counts = (
        data.groupBy("_by")
        .agg(
            *[
                F.count_if((F.col(t.column) < F.lit(t.low)) & F.col("_by").eqNullSafe(F.lit(t.group))).alias(f"b_{i}")
                for i, t in enumerate(targets)
            ],
            *[
                F.count_if((F.col(t.column) <= F.lit(t.high)) & F.col("_by").eqNullSafe(F.lit(t.group))).alias(
                    f"u_{i}"
                )
                for i, t in enumerate(targets)
            ],
        )
        .collect()
    )
    by_group = {row["_by"]: row for row in counts}
    extremes = {
        (c, row["_by"]): (row[f"min_{i}"], row[f"max_{i}"]) for row in first for i, c in enumerate(columns)
    }
    for i, t in enumerate(targets):
        row = by_group[t.group]
        t.below = row[f"b_{i}"]
        inside = t.below <= math.floor(t.position) and math.ceil(t.position) < row[f"u_{i}"]
        if not inside:  # the sketch missed: take the whole range, still exact
            t.low, t.high = extremes[(t.column, t.group)]
            t.below = 0
    return targets


def exact_percentiles(
    frame: DataFrame, columns: Sequence[str], shares: Sequence[float], by: str | None = None, small: int = SMALL
) -> list[Target]:
    """Exact linear-interpolation percentiles of several columns; ``Target.low`` holds the value.

    ``by`` may name a column with few values (a class label).  NULL and NaN are ignored.
    The result is one small record per (column, group, share).
    """
    data = _doubles(frame, columns, by)
    first = _sketch(data, columns, shares)
    largest = max((row[f"n_{i}"] for row in first for i in range(len(columns))), default=0)
    if largest <= small:
        return _built_in(data, columns, shares)
    targets = _brackets(data, first, columns, shares)
    open_targets = [t for t in targets if t.low < t.high]
    if open_targets:
        _close(data, open_targets)
    return targets


def _close(data: DataFrame, targets: list[Target]) -> None:
    """Rank the values inside the open brackets and replace each bracket by its percentile."""
    cells = F.array(
        *[
            F.when(
                F.col("_by").eqNullSafe(F.lit(t.group)) & F.col(t.column).between(t.low, t.high),
                F.struct(F.lit(i).alias("target"), F.col(t.column).alias("value")),
            )
            for i, t in enumerate(targets)
        ]
    )
    inside = (
        data.select(F.explode(F.array_compact(cells)).alias("cell"))
        .groupBy(F.col("cell.target").alias("target"), F.col("cell.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(staged(inside, "percentile"), "value", ["n"], by=["target"], descending=False)

    def value_at(rank_of_target: str):
        # first value whose running count passes the wanted rank
        return F.min(F.when(F.col("cum_n") > F.col(rank_of_target), F.col("value")))

    lower, upper = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for i, t in enumerate(targets):
        lower = F.when(F.col("target") == i, F.lit(math.floor(t.position) - t.below)).otherwise(lower)
        upper = F.when(F.col("target") == i, F.lit(math.ceil(t.position) - t.below)).otherwise(upper)
    picked = (
        ranked.withColumn("r_low", lower)
        .withColumn("r_high", upper)
        .groupBy("target")
        .agg(value_at("r_low").alias("v_low"), value_at("r_high").alias("v_high"))
        .collect()  # one row per target
    )
    for row in picked:
        t = targets[row["target"]]
        part = t.position - math.floor(t.position)
        value = row["v_low"] + (row["v_high"] - row["v_low"]) * part
        t.low = t.high = value


def percentile_values(frame: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """One percentile per column: {column: share} to {column: value}."""
    shares = sorted(set(wanted.values()))
    found = exact_percentiles(frame, list(wanted), shares)
    return {t.column: t.low for t in found if t.share == wanted[t.column]}
