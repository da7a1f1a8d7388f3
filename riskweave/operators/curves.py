"""Precision-recall and ROC curves of a scored table, exact and without a global sort.

Rows are first counted per distinct score (map-side combined, so a score shared by a third
of all rows is one row afterwards); cumulative counts over the scores then give every
point.  ``by`` computes many curves at once (models, datasets, folds, iterations).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.running import ROWS_PER_RANGE, running_totals
from riskweave.sources.scratch import staged


def complete(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The same rows; reading a NULL label, or a NULL or NaN score, raises: a metric over the rest would mislead.

    The check is part of the row expression, so it costs no pass of its own.
    """
    s = F.col(score).cast("double")
    missing = s.isNull() | F.isnan(s) | F.col(label).isNull()
    fault = F.raise_error(F.lit(f"missing value in {score!r} or {label!r}")).cast("double")
    return scored.withColumn(score, F.when(missing, fault).otherwise(s))


def score_counts(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Positives and negatives per distinct score; a missing score or label is refused by ``complete``."""
    s = F.col(score).cast("double")
    usable = complete(scored, label, score)
    return usable.groupBy(*by, s.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def threshold_curve(
    counts: DataFrame,
    by: Sequence[str] = (),
    following: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per distinct score s: confusion counts, precision and recall of ``score >= s``.

    ``counts`` comes from :func:`score_counts`.  Recall is NULL when there is no positive.
    ``position`` numbers the points from the lowest threshold, starting at 0.
    """
    base = staged(counts.withColumn("n_points", F.lit(1)), "score-counts")
    run = running_totals(
        base, "score", ["n_pos", "n_neg", "n_points"], by, following=following, rows_per_range=rows_per_range
    )
    tp, fp = F.col("cum_n_pos"), F.col("cum_n_neg")
    all_pos, all_neg = F.col("all_n_pos"), F.col("all_n_neg")
    return run.select(
        *by,
        F.col("score").alias("threshold"),
        "n_pos",
        "n_neg",
        tp.alias("tp"),
        fp.alias("fp"),
        (all_pos - tp).alias("fn"),
        (all_neg - fp).alias("tn"),
        (tp / (tp + fp)).alias("precision"),
        F.when(all_pos > 0, tp / all_pos).alias("recall"),
        (F.col("all_n_points") - F.col("cum_n_points")).alias("position"),
        F.col("all_n_points").alias("n_points"),
        *[F.col(f"next_{c}") for c in following],
    )


def curve_of(scored: DataFrame, by: Sequence[str] = (), **columns) -> DataFrame:
    return threshold_curve(score_counts(scored, by, **columns), by)


def ranking_aggregates() -> dict[str, Column]:
    """Average precision and ROC AUC (ties count one half) as aggregates over a curve."""
    positives = F.max(F.col("tp") + F.col("fn"))
    negatives = F.max(F.col("fp") + F.col("tn"))
    precise = F.sum(F.col("precision") * F.col("n_pos"))
    wins = F.sum(F.col("n_neg") * (F.col("tp") - F.col("n_pos") / F.lit(2.0)))
    pairs = positives.cast("double") * negatives
    return {
        "pr_auc": F.when(positives > 0, precise / positives),
        "roc_auc": F.when(pairs > 0, wins / pairs),
    }


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(*[c.alias(n) for n, c in ranking_aggregates().items()])


def roc_points(
    scored: DataFrame, by: Sequence[str] = (), drop_collinear: bool = False, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """ROC points from the highest threshold down, with the start point (0, 0) at threshold +inf.

    A point is collinear when the next lower score adds the same counts as this one does.
    """
    following = ["n_pos", "n_neg"] if drop_collinear else []
    curve = threshold_curve(score_counts(scored, by), by, following, rows_per_range)
    if drop_collinear:
        same = (F.col("next_n_pos") == F.col("n_pos")) & (F.col("next_n_neg") == F.col("n_neg"))
        curve = curve.filter(~F.coalesce(same, F.lit(False)))
    points = curve.select(
        *by,
        "threshold",
        F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"),
        F.col("recall").alias("tpr"),
    )
    # the lowest threshold is always kept, so it stands for its group
    groups = curve.filter(F.col("position") == 0) if by else scored.sparkSession.range(1)
    start = groups.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def sampled_sweep(curve: DataFrame, points: int = 1000) -> DataFrame:
    """Every step-th point from the lowest threshold up, step = max(1, n div ``points``), with F1."""
    step = F.greatest(F.lit(1), F.expr(f"n_points div {int(points)}"))
    return curve.filter(F.col("position") % step == 0).select(
        "threshold", "precision", "recall", f1_smoothed().alias("f1")
    )


def f1_smoothed():
    """F1 with the small constant that keeps 0/0 at zero."""
    p, r = F.col("precision"), F.col("recall")
    return F.lit(2.0) * p * r / (p + r + F.lit(1e-10))


def f1_exact():
    p, r = F.col("precision"), F.col("recall")
    return F.when(p + r > 0, F.lit(2.0) * (p * r) / (p + r)).otherwise(F.lit(0.0))
