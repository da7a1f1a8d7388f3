"""Exact running totals over a frame of any length.

A plain window ordered over all rows plans one single partition.  Here the order
column is cut into ranges whose boundaries are plain constants, so a row's range is a
deterministic function of its value; totals per range are few, and the running sum
inside each range runs in parallel.  The join that brings the offsets back and the
window share one shuffle on (group, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 250_000
MAX_RANGES = 20_000
SKETCH_ACCURACY = 10_000


def range_boundaries(frame: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner boundaries that cut ``order`` into ranges of about ``rows_per_range`` rows."""
    rows = frame.count()
    ranges = min(MAX_RANGES, -(-rows // rows_per_range))
    if ranges <= 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    cuts = frame.agg(
        F.percentile_approx(order, shares, max(SKETCH_ACCURACY, 4 * ranges)).alias("cuts")
    ).first()["cuts"]
    return sorted(set(cuts))


def running_totals(
    frame: DataFrame,
    order: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    following: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``cum_<c>`` and ``all_<c>`` per column of ``totals``, and ``next_<c>`` per column of ``following``.

    ``frame`` must hold distinct ``order`` values within each group of ``by`` and should be a
    stored table, because it is read three times (boundaries, range totals, rows).
    ``order`` must be double and not null.
    """
    by = list(by)
    cuts = range_boundaries(frame, order, rows_per_range)
    in_order = F.col(order).desc() if descending else F.col(order).asc()
    if not cuts:  # at most rows_per_range rows in all: one window per group
        return _single_range(frame, in_order, totals, by, following)
    splits = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range", handleInvalid="keep").transform(frame)

    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    edge = F.max_by if descending else F.min_by
    sums = [F.sum(c).alias(f"_sum_{c}") for c in totals]
    if following:
        sums.append(edge(F.struct(*[F.col(c) for c in following]), F.col(order)).alias("_edge"))
    per_range = ranged.groupBy(*by, "_range").agg(*sums)

    # At most MAX_RANGES rows per group: bounded whatever the size of ``frame``.
    whole = Window.partitionBy(*_group(by))
    ahead = whole.orderBy(range_order)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in totals],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in totals],
        *([F.lead("_edge").over(ahead).alias("_next_edge")] if following else []),
    )

    inner = Window.partitionBy(*by, "_range").orderBy(in_order)
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(offsets, [*by, "_range"])

    def next_value(name: str) -> Column:
        return F.coalesce(F.lead(name).over(inner), F.col("_next_edge").getField(name)).alias(f"next_{name}")

    return joined.select(
        *frame.columns,
        *[(F.col(f"_before_{c}") + F.sum(c).over(run)).alias(f"cum_{c}") for c in totals],
        *[F.col(f"all_{c}") for c in totals],
        *[next_value(c) for c in following],
    )


def _group(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def _single_range(
    frame: DataFrame, in_order: Column, totals: Sequence[str], by: Sequence[str], following: Sequence[str]
) -> DataFrame:
    whole = Window.partitionBy(*_group(by))
    ordered = whole.orderBy(in_order)
    run = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.select(
        *frame.columns,
        *[F.sum(c).over(run).alias(f"cum_{c}") for c in totals],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in totals],
        *[F.lead(c).over(ordered).alias(f"next_{c}") for c in following],
    )
