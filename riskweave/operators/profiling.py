"""Profiling of the transaction table: distributions, associations, rates, outliers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import banded, literal_map, refuse_infinite, stacked, without_nan
from riskweave.operators.quantiles import exact_percentiles


def unpivoted(frame: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with every value as text."""
    texts = frame.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(list(keep), list(columns), "feature", "value")


# ---- label -------------------------------------------------------------------


def class_distribution(frame: DataFrame, label: str = "is_fraud", limit: float = 10.0) -> DataFrame:
    """Rows and share per class, with the ratio of the two largest classes and a flag above ``limit``."""
    counts = frame.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # one row per class from here on
    classes = Window.partitionBy(F.lit(0))
    sizes = F.sort_array(F.collect_list("n").over(classes), asc=False)
    share = F.col("n") / F.sum("n").over(classes)
    largest, second = F.get("sizes", F.lit(0)), F.get("sizes", F.lit(1))
    return (
        counts.select("label", "n", share.alias("share"), sizes.alias("sizes"))
        .withColumn("imbalance_ratio", F.when(F.size("sizes") > 1, largest / second).otherwise(F.lit(1.0)))
        .withColumn("is_imbalanced", (F.col("imbalance_ratio") > limit).cast("int"))
        .drop("sizes")
    )


def baseline_rate(frame: DataFrame, label: str = "is_fraud") -> DataFrame:
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("baseline_rate")
    )


# ---- categorical columns -----------------------------------------------------


def top_values(frame: DataFrame, columns: Sequence[str], top_n: int = 5) -> DataFrame:
    """Distinct count and most frequent values of each column; equal counts are ordered by value."""
    counts = (
        unpivoted(frame, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    distinct = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    # the rank filter becomes a per-task group limit, so only top_n rows per feature and task are shuffled
    by_size = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= top_n)
    return ranked.join(distinct, "feature").select("feature", "n_distinct", "rank", "value", "n")


def mutual_information(frame: DataFrame, columns: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """Mutual information (natural log) of each column with the label, best first.

    Uses H(X) + H(Y) - H(X, Y): each entropy is a plain sum of n ln n over a grouped
    count, so no task has to hold all values of a feature.
    """
    cells = (
        unpivoted(frame, columns, [label])
        .groupBy("feature", "value", F.col(label).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = cells.groupingSets(
        [
            [F.col("feature"), F.col("value"), F.col("y")],
            [F.col("feature"), F.col("value")],
            [F.col("feature"), F.col("y")],
        ],
        F.col("feature"),
        F.col("value"),
        F.col("y"),
    ).agg(F.sum("n").alias("n"), F.grouping("value").alias("no_value"), F.grouping("y").alias("no_y"))
    n_ln_n = F.col("n") * F.log(F.col("n").cast("double"))
    marginal = (F.col("no_value") + F.col("no_y")) == 1
    total = F.sum(F.when(~marginal, F.col("n")))
    score = (F.sum(F.when(marginal, -n_ln_n).otherwise(n_ln_n)) / total) + F.log(total.cast("double"))
    return (
        parts.groupBy("feature")
        .agg(F.greatest(F.lit(0.0), score).alias("mi_score"))
        .orderBy(F.col("mi_score").desc(), "feature")
    )


def category_rates(
    frame: DataFrame,
    columns: Sequence[str],
    label: str = "is_fraud",
    baseline: float | None = None,
    risk_factor: float = 1.5,
) -> DataFrame:
    """Positives, rows and rate (in percent) per category, flagged above ``risk_factor`` x baseline."""
    counts = (
        unpivoted(frame, columns, [label])
        .groupBy("feature", "value")
        .agg(F.sum(label).alias("target_count"), F.count(label).alias("total_count"))
    )
    # every row is counted once per feature, above and below the line, so this is the overall rate;
    # it reads the grouped counts, not the rows again
    overall = counts.agg(F.sum("target_count") / F.sum("total_count"))
    rates = (
        counts.filter(F.col("value").isNotNull())
        .withColumn("target_rate", F.col("target_count") / F.col("total_count") * 100)
        .withColumn("_base", overall.scalar() if baseline is None else F.lit(float(baseline)))
    )
    return rates.select(
        "feature",
        "value",
        "target_count",
        "total_count",
        "target_rate",
        (F.col("target_rate") > F.col("_base") * 100 * risk_factor).cast("int").alias("is_high_risk"),
    ).orderBy("feature", F.col("target_rate").desc(), "value")


# ---- numeric columns ---------------------------------------------------------


def describe(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max of each column; NaN counts as missing in all of them."""
    frame = without_nan(frame, columns)
    quartiles = {(t.column, t.share): t.low for t in exact_percentiles(frame, columns, [0.25, 0.5, 0.75])}
    moments = frame.agg(
        *[
            f(c).alias(f"{name}_{c}")
            for c in columns
            for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    rows = [
        [
            F.lit(c),
            F.col(f"n_{c}"),
            F.col(f"mean_{c}"),
            F.col(f"std_{c}"),
            F.col(f"min_{c}").cast("double"),
            *[F.lit(quartiles.get((c, s))).cast("double") for s in (0.25, 0.5, 0.75)],
            F.col(f"max_{c}").cast("double"),
        ]
        for c in columns
    ]
    names = ["feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return moments.select(stacked(rows, names)).select("row.*")


def label_correlations(frame: DataFrame, columns: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """Pearson correlation with the label, strongest first; a constant column gives NULL, NaN is missing."""
    frame = without_nan(frame, [*columns, label])
    aggregates, rows = [], []
    for c in columns:
        y = F.col(label).cast("double")
        x = F.when(y.isNotNull(), F.col(c).cast("double"))
        y = F.when(x.isNotNull(), y)
        # from the moments: the built-in correlation fails on a constant side
        aggregates += [
            F.covar_pop(x, y).alias(f"c_{c}"),
            (F.stddev_pop(x) * F.stddev_pop(y)).alias(f"s_{c}"),
            ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias(f"v_{c}"),
        ]
        rows.append([F.lit(c), F.when(F.col(f"v_{c}"), F.col(f"c_{c}") / F.col(f"s_{c}"))])
    return (
        frame.agg(*aggregates)
        .select(stacked(rows, ["feature", "correlation"]))
        .select("row.*")
        .orderBy(F.abs("correlation").desc_nulls_last(), "feature")
    )


def gram_matrix(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of every pair of columns, from one pass: (feature_a, feature_b, value); NaN is missing."""
    frame = without_nan(frame, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = frame.agg(
        *[
            F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"g_{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = [[F.lit(a), F.lit(b), F.col(f"g_{i}")] for i, (a, b) in enumerate(pairs)]
    return sums.select(stacked(rows, ["feature_a", "feature_b", "value"])).select("row.*")


def inflation_factors(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation of each column from uncentred regressions on the others, highest first.

    Only the k x k Gram matrix reaches the driver; a singular matrix gives NULL.
    """
    size = {c: i for i, c in enumerate(columns)}
    gram = np.zeros((len(columns), len(columns)))
    for row in gram_matrix(frame, columns).collect():
        i, j = size[row["feature_a"]], size[row["feature_b"]]
        gram[i, j] = gram[j, i] = row["value"] or 0.0
    refuse_infinite(dict(zip(columns, np.diag(gram).tolist())), "inflation factors")
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(scale, scale)
    values: list[float | None] = [None] * len(columns)
    if np.linalg.matrix_rank(scaled) == len(columns):
        values = [float(v) for v in np.diag(np.linalg.inv(scaled))]
    rows = sorted(zip(columns, values), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    return frame.sparkSession.createDataFrame(rows, "feature string, vif double")


def inflation_bands(factors: DataFrame, moderate: float = 5.0, high: float = 10.0) -> DataFrame:
    return factors.withColumn(
        "band",
        F.when(F.col("vif").isNull(), F.lit("undefined")).otherwise(
            banded(F.col("vif"), [(high, "high"), (moderate, "moderate")], "low", strict=True)
        ),
    )


def histogram(frame: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins per column with the column's mean and median; empty bins are left out.

    NaN is missing; a column without values gives one row with n = 0 and nothing else; infinite values raise.
    """
    frame = without_nan(frame, columns)
    ends = frame.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
    ).first()
    refuse_infinite({c: ends[f"lo_{c}"] for c in columns}, "histogram")
    refuse_infinite({c: ends[f"hi_{c}"] for c in columns}, "histogram")
    medians = {t.column: t.low for t in exact_percentiles(frame, columns, [0.5])}
    edges: dict[str, tuple[float, float]] = {}
    cells = []
    for c in columns:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None:
            continue
        if lo == hi:  # a constant column gets one unit of width around it
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        edges[c] = (lo, width)
        value = F.col(c).cast("double")
        index = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(c).alias("feature"), index.alias("bin"))))
    counted = (
        frame.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"))
        .groupBy(F.col("cell.feature").alias("feature"), F.col("cell.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nothing = frame.sparkSession.createDataFrame(
        [(c,) for c in columns if c not in edges], "feature string"
    ).selectExpr("feature", "CAST(NULL AS INT) AS bin", "CAST(NULL AS DOUBLE) AS bin_start", "0L AS n",
                 "CAST(NULL AS DOUBLE) AS mean", "CAST(NULL AS DOUBLE) AS median")
    if not edges:
        return nothing
    low = F.element_at(literal_map({c: e[0] for c, e in edges.items()}), F.col("feature"))
    width = F.element_at(literal_map({c: e[1] for c, e in edges.items()}), F.col("feature"))
    binned = counted.select(
        "feature",
        "bin",
        (low + width * F.col("bin")).alias("bin_start"),
        "n",
        F.element_at(literal_map({c: ends[f"mean_{c}"] for c in edges}), F.col("feature")).alias("mean"),
        F.element_at(literal_map({c: medians[c] for c in edges}), F.col("feature")).alias("median"),
    )
    return binned if len(edges) == len(columns) else binned.unionByName(nothing)


def box_statistics(frame: DataFrame, columns: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per column and class.

    The quartiles are a handful of numbers (columns x classes), so the second pass uses
    them as constants and groups by class only.
    """
    frame = without_nan(frame, columns)
    found = exact_percentiles(frame, columns, [0.25, 0.5, 0.75], by=label)
    if any(t.group is None for t in found):
        raise ValueError(f"label {label!r} is NULL in some rows")
    q = {(t.column, t.group, t.share): t.low for t in found}
    classes = sorted({t.group for t in found})

    def per_class(values: dict) -> Column:
        return F.element_at(literal_map(values), F.col(label))

    aggregates, rows = [], []
    for c in columns:
        have = [k for k in classes if (c, k, 0.25) in q]
        low_fence, high_fence = {}, {}
        for k in have:
            spread = q[(c, k, 0.75)] - q[(c, k, 0.25)]
            low_fence[k] = q[(c, k, 0.25)] - 1.5 * spread
            high_fence[k] = q[(c, k, 0.75)] + 1.5 * spread
        value = F.col(c).cast("double")
        inside = (value >= per_class(low_fence)) & (value <= per_class(high_fence))
        aggregates += [
            F.min(F.when(inside, value)).alias(f"low_{c}"),
            F.max(F.when(inside, value)).alias(f"high_{c}"),
            F.count_if(~inside).alias(f"out_{c}"),
            F.count(value).alias(f"n_{c}"),
        ]
        quartile = [per_class({k: q[(c, k, s)] for k in have}) for s in (0.25, 0.5, 0.75)]
        rows.append(
            [F.lit(c), F.col(label), F.col(f"n_{c}"), *quartile]
            + [F.col(f"low_{c}"), F.col(f"high_{c}"), F.col(f"out_{c}")]
        )
    names = ["feature", "label", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    return frame.groupBy(label).agg(*aggregates).select(stacked(rows, names)).select("row.*")


def binned_rates(
    frame: DataFrame,
    column: str = "amount",
    bounds: Sequence[float] = (100, 500, 1000, 2000),
    label: str = "is_fraud",
    measure: str | None = None,
) -> DataFrame:
    """Label rate (and mean of ``measure``) per value range of one column."""
    names = (
        [f"0-{bounds[0]}"] + [f"{a}-{b}" for a, b in zip(bounds, bounds[1:])] + [f"{bounds[-1]}+"]
    )
    band = banded(F.col(column), list(zip(reversed(bounds), reversed(names[1:]))), names[0])
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("positives"),
        F.avg(label).alias("label_rate"),
    ]
    if measure:
        aggregates.append(F.avg(measure).alias(f"mean_{measure}"))
    return frame.groupBy(band.alias("value_range")).agg(*aggregates)


# ---- time --------------------------------------------------------------------


def temporal_rates(frame: DataFrame, time_column: str = "transaction_time", label: str = "is_fraud") -> DataFrame:
    """Label rate by hour, weekday, month and weekend, all from one pass: (dimension, bucket, n, positives, rate)."""
    time = F.col(time_column)
    parts = frame.select(
        F.hour(time).alias("hour"),
        F.weekday(time).alias("day_of_week"),
        F.month(time).alias("month"),
        (F.weekday(time) >= 5).cast("int").alias("is_weekend"),
        F.col(label).alias("_y"),
    )
    dims = ["hour", "day_of_week", "month", "is_weekend"]
    # count per distinct combination first, so only a few thousand rows meet the grouping sets
    compact = parts.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p"))
    sets = compact.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("positives"), *[F.grouping(d).alias(f"g_{d}") for d in dims]
    )
    name, bucket = F.lit(None).cast("string"), F.lit(None).cast("int")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        bucket = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(bucket)
    return sets.select(
        name.alias("dimension"),
        bucket.alias("bucket"),
        "n",
        "positives",
        (F.col("positives") / F.col("n")).alias("rate"),
    ).filter(F.col("bucket").isNotNull())


def hour_extremes(rates: DataFrame) -> DataFrame:
    """Hours with the highest and the lowest rate; the earlier hour wins ties."""
    hours = rates.filter(F.col("dimension") == "hour")
    return hours.agg(
        F.max(F.struct("rate", (-F.col("bucket")).alias("neg_bucket"))).alias("top"),
        F.min(F.struct("rate", "bucket")).alias("low"),
    ).select(
        (-F.col("top.neg_bucket")).alias("peak_hour"),
        F.col("top.rate").alias("peak_rate"),
        F.col("low.bucket").alias("safest_hour"),
        F.col("low.rate").alias("safest_rate"),
    )


def risky_hours(rates: DataFrame, baseline: float | Column, factor: float = 1.2) -> DataFrame:
    """Hours whose rate is above ``factor`` x baseline, with the multiple of the baseline."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    return (
        rates.filter(F.col("dimension") == "hour")
        .filter(F.col("rate") > base * factor)
        .select(F.col("bucket").alias("hour"), "rate", (F.col("rate") / base).alias("times_baseline"))
    )


# ---- screening ---------------------------------------------------------------


def screening_report(
    frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "is_fraud"
) -> DataFrame:
    """Which features to keep or drop, and why: top-5 correlation, information > 0.01, inflation > 10."""
    correlated = label_correlations(frame, numeric, label).limit(5)
    informative = mutual_information(frame, categorical, label).filter(F.col("mi_score") > 0.01)
    inflated = inflation_factors(frame, numeric).filter(F.col("vif") > 10)

    def part(rows: DataFrame, value: str, action: str, reason: str) -> DataFrame:
        return rows.select(
            "feature", F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.col(value).alias("value")
        )

    return (
        part(correlated, "correlation", "keep", "label correlation")
        .unionByName(part(informative, "mi_score", "keep", "mutual information"))
        .unionByName(part(inflated, "vif", "drop", "variance inflation"))
    )
