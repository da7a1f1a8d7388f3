"""Classification metrics, model comparison and change reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import banded, ratio_if_positive, stacked
from riskweave.operators.curves import complete, ranking_aggregates, score_counts, threshold_curve


def confusion(
    scored: DataFrame,
    by: Sequence[str] = (),
    threshold: float = fv.DEFAULT_THRESHOLD,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """TP, FP, TN, FN of ``score >= threshold``; missing scores and labels raise."""
    scored = complete(scored, label, score)
    hit, real = F.col(score) >= F.lit(threshold), F.col(label) == 1
    return scored.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & ~real).alias("tn"),
        F.count_if(~hit & real).alias("fn"),
    )


def with_threshold_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from confusion counts; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "precision": ratio_if_positive(tp, tp + fp),
            "recall": ratio_if_positive(tp, tp + fn),
            "f1": ratio_if_positive(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
            "accuracy": ratio_if_positive(tp + tn, tp + fp + tn + fn),
        }
    )


def evaluate(
    scored: DataFrame,
    by: Sequence[str] = (),
    threshold: float = fv.DEFAULT_THRESHOLD,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """All six metrics and the confusion counts per group.

    Everything comes from the counts per distinct score: rows are shuffled once, already
    combined, whatever the number of groups and metrics.
    """
    curve = threshold_curve(score_counts(scored, by, label, score), by)
    hit = F.col("threshold") >= F.lit(threshold)
    tally = curve.groupBy(*by).agg(
        *[c.alias(n) for n, c in ranking_aggregates().items()],
        F.sum(F.when(hit, F.col("n_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("n_neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("n_pos")).otherwise(0)).alias("fn"),
    )
    return with_threshold_metrics(tally).select(*by, *fv.METRICS, "tp", "fp", "tn", "fn")


def long_metrics(wide: DataFrame, by: Sequence[str], metrics: Sequence[str] = tuple(fv.METRICS)) -> DataFrame:
    """Wide metric columns to rows (by..., metric, value)."""
    doubles = wide.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(by), list(metrics), "metric", "value")


def compare_models(model_metrics: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per model with the requested metrics that exist; a ``dataset`` column is dropped."""
    available = [c for c in model_metrics.columns if c not in ("model", "dataset")]
    chosen = available if metrics is None else [m for m in metrics if m in available]
    return model_metrics.select("model", *chosen)


def best_per_metric(comparison: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Best model for every metric; equal values go to the model first by name."""
    chosen = metrics or [c for c in comparison.columns if c != "model"]
    rows = long_metrics(comparison, ["model"], chosen)
    order = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), F.col("model"))
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("metric", "model", "value")


def best_model(comparison: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """The row of the best model by one metric."""
    if metric not in comparison.columns or metric == "model":
        raise ValueError(f"metric {metric!r} not found, have {[c for c in comparison.columns if c != 'model']}")
    return comparison.orderBy(F.col(metric).desc_nulls_last(), "model").limit(1)


# --- fixed values: bands of the validation-to-test difference, in percent --------
GENERALISATION_BANDS = [(5.0, "concerning"), (2.0, "acceptable"), (1.0, "good")]


def validation_vs_test(
    validation: DataFrame, test: DataFrame, metrics: Sequence[str] = ("roc_auc", "pr_auc", "f1", "precision", "recall")
) -> DataFrame:
    """Per model and metric: difference, percent difference, band, overall verdict on PR-AUC, consistency.

    Both inputs hold one row per model.
    """
    v = long_metrics(validation, ["model"], metrics).withColumnRenamed("value", "validation")
    t = long_metrics(test, ["model"], metrics).withColumnRenamed("value", "test")
    diff = F.col("test") - F.col("validation")
    rows = v.join(t, ["model", "metric"]).select(
        "model",
        "metric",
        "validation",
        "test",
        diff.alias("diff"),
        F.when(F.col("validation") != 0, diff / F.col("validation") * 100).alias("diff_pct"),
    )
    band = banded(F.abs(F.col("diff_pct")), GENERALISATION_BANDS, "excellent")
    overall = Window.partitionBy("model")  # one small group per model: the metrics
    main = F.col("metric") == "pr_auc"
    return rows.select(
        "*",
        band.alias("status"),
        F.max(F.when(main, band)).over(overall).alias("generalisation"),
        F.max(F.when(main, (F.col("test") >= F.col("validation") * 0.98).cast("int"))).over(overall).alias(
            "is_consistent"
        ),
    )


def tuning_change(
    baseline: DataFrame, tuned: DataFrame, metrics: Sequence[str] = ("pr_auc", "roc_auc", "f1", "precision", "recall")
) -> DataFrame:
    """Change from baseline to tuned per metric, absolute and in percent (one row per input)."""
    values = F.struct(*[F.col(m).cast("double").alias(m) for m in metrics])
    b = baseline.select(*[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    b = b.withColumn("_t", tuned.select(values).scalar())
    b = b.select(*b.columns, *[F.col(f"_t.{m}").alias(f"t_{m}") for m in metrics])
    rows = []
    for m in metrics:
        change = F.col(f"t_{m}") - F.col(f"b_{m}")
        percent = F.when(F.col(f"b_{m}") != 0, change / F.col(f"b_{m}") * 100)
        rows.append([F.lit(m), F.col(f"b_{m}"), F.col(f"t_{m}"), change, percent])
    names = ["metric", "baseline", "tuned", "change", "change_pct"]
    return b.select(stacked(rows, names)).select("row.*")
