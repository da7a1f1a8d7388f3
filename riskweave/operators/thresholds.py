"""Decision thresholds chosen on the precision-recall curve.

Each strategy is one conditional maximum over structs, so all strategies together take a
single aggregation of the curve; no sort and no join is involved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import lookup, ratio_if_positive
from riskweave.operators.curves import f1_exact, f1_smoothed

POINT = ["threshold", "precision", "recall", "tp", "fp", "tn", "fn"]
STRATEGY_COLUMNS = [
    "strategy",
    "threshold",
    "precision",
    "recall",
    "f1",
    "target_recall",
    "min_precision",
    "tp",
    "fp",
    "tn",
    "fn",
]


def _best(goal: Column, allowed: Column | None = None) -> Column:
    """The point with the highest ``goal``; the lowest threshold wins ties."""
    ranked = F.struct(
        goal.alias("goal"),
        (-F.col("threshold")).alias("tie"),
        *[F.col(c) for c in POINT],
        f1_exact().alias("f1_exact"),
        f1_smoothed().alias("f1_smoothed"),
    )
    return F.max(ranked if allowed is None else F.when(allowed, ranked))


def _optimal_f1() -> Column:
    return _best(f1_smoothed())


def _most_precise(target_recall: float) -> Column:
    return _best(F.col("precision"), F.col("recall") >= F.lit(target_recall))


def _widest_recall(min_precision: float) -> Column:
    return _best(F.col("recall"), F.col("precision") >= F.lit(min_precision))


def _rows(curve: DataFrame, by: Sequence[str], picks: list[tuple[str, Column, str, float | None, float | None]]):
    """One row per (group, strategy); strategies without any allowed point are left out."""
    best = curve.groupBy(*by).agg(*[pick.alias(f"s{i}") for i, (_, pick, *_rest) in enumerate(picks)])
    cells = [
        F.when(
            F.col(f"s{i}").isNotNull(),
            F.struct(
                F.lit(name).alias("strategy"),
                *[F.col(f"s{i}.{c}").alias(c) for c in ("threshold", "precision", "recall")],
                F.col(f"s{i}.{f1}").alias("f1"),
                F.lit(target).cast("double").alias("target_recall"),
                F.lit(floor).cast("double").alias("min_precision"),
                *[F.col(f"s{i}.{c}").alias(c) for c in ("tp", "fp", "tn", "fn")],
            ),
        )
        for i, (name, _, f1, target, floor) in enumerate(picks)
    ]
    return best.select(*by, F.explode(F.array_compact(F.array(*cells))).alias("row")).select(
        *by, *[F.col(f"row.{c}").alias(c) for c in STRATEGY_COLUMNS]
    )


def optimal_f1_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _rows(curve, by, [("optimal_f1", _optimal_f1(), "f1_smoothed", None, None)])


def recall_thresholds(
    curve: DataFrame, targets: Mapping[str, float] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Most precise point with recall at or above each named target."""
    targets = fv.RECALL_TARGETS if targets is None else targets
    return _rows(curve, by, [(n, _most_precise(t), "f1_exact", t, None) for n, t in targets.items()])


def precision_threshold(
    curve: DataFrame, min_precision: float = fv.MIN_PRECISION, by: Sequence[str] = ()
) -> DataFrame:
    """Point with the widest recall whose precision is at least ``min_precision``."""
    return _rows(
        curve, by, [("target_performance", _widest_recall(min_precision), "f1_exact", None, min_precision)]
    )


def all_strategies(
    curve: DataFrame,
    targets: Mapping[str, float] | None = None,
    min_precision: float = fv.MIN_PRECISION,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every strategy with its confusion counts, from one pass over the curve."""
    targets = fv.RECALL_TARGETS if targets is None else targets
    picks = [
        ("optimal_f1", _optimal_f1(), "f1_smoothed", None, None),
        ("target_performance", _widest_recall(min_precision), "f1_exact", None, min_precision),
    ]
    picks += [(n, _most_precise(t), "f1_exact", t, None) for n, t in targets.items()]
    return _rows(curve, by, picks)


def nearest_recall_thresholds(
    curve: DataFrame, targets: Mapping[str, float] | None = None
) -> DataFrame:
    """Older rule: recall closest to each target, and the best F1.

    The curve's end point (precision 1, recall 0) takes part; if it is strictly closest,
    the highest threshold is reported with it.
    """
    targets = fv.RECALL_TARGETS if targets is None else targets
    point = [F.col(c) for c in ("threshold", "precision", "recall")]
    nearest = {
        name: F.min(F.struct(F.abs(F.col("recall") - F.lit(t)).alias("gap"), *point, f1_exact().alias("f1")))
        for name, t in targets.items()
    }
    best = curve.agg(
        _optimal_f1().alias("s_f1"),
        F.max("threshold").alias("top"),
        *[pick.alias(f"s_{i}") for i, pick in enumerate(nearest.values())],
    )
    cells = [
        F.struct(
            F.lit("optimal_f1").alias("strategy"),
            F.lit(None).cast("double").alias("target_recall"),
            F.col("s_f1.threshold").alias("threshold"),
            F.col("s_f1.precision").alias("precision"),
            F.col("s_f1.recall").alias("recall"),
            F.col("s_f1.f1_smoothed").alias("f1"),
        )
    ]
    for i, (name, t) in enumerate(targets.items()):
        at_end = F.lit(float(t)) < F.col(f"s_{i}.gap")
        cells.append(
            F.struct(
                F.lit(name).alias("strategy"),
                F.lit(float(t)).alias("target_recall"),
                F.when(at_end, F.col("top")).otherwise(F.col(f"s_{i}.threshold")).alias("threshold"),
                F.when(at_end, F.lit(1.0)).otherwise(F.col(f"s_{i}.precision")).alias("precision"),
                F.when(at_end, F.lit(0.0)).otherwise(F.col(f"s_{i}.recall")).alias("recall"),
                F.when(at_end, F.lit(0.0)).otherwise(F.col(f"s_{i}.f1")).alias("f1"),
            )
        )
    return best.filter(F.col("top").isNotNull()).select(F.explode(F.array(*cells)).alias("row")).select("row.*")


def with_error_rates(strategies: DataFrame) -> DataFrame:
    return strategies.withColumns(
        {
            "fpr": ratio_if_positive(F.col("fp"), F.col("fp") + F.col("tn")),
            "fnr": ratio_if_positive(F.col("fn"), F.col("fn") + F.col("tp")),
        }
    )


def comparison_table(strategies: DataFrame) -> DataFrame:
    """Strategies with display names, reduced to the columns people compare."""
    percent = F.round(F.coalesce(F.col("target_recall"), F.col("min_precision")) * 100, 0).cast("int").cast("string")
    fallback = F.when(F.col("target_recall").isNotNull(), F.concat(percent, F.lit("% Recall"))).otherwise(
        F.col("strategy")
    )
    title = F.when(
        F.col("strategy") == "target_performance",
        F.concat(F.lit("Target Performance (>="), percent, F.lit("% Prec)")),
    ).otherwise(lookup(fv.STRATEGY_TITLES, F.col("strategy"), fallback))
    return strategies.select(
        title.alias("strategy"), "threshold", "precision", "recall", "f1", "fp", "fn"
    )


def strategy_artifact(strategies: DataFrame) -> DataFrame:
    """The stored form: strategies, notes, risk bands, default threshold and the recommended one."""
    # a handful of rows: whether target_performance exists decides the recommendation
    is_target = F.col("strategy") == "target_performance"
    recommended = F.when(F.max(is_target).over(Window.partitionBy(F.lit(0))), F.lit("target_performance")).otherwise(
        F.lit("optimal_f1")
    )
    bands = F.create_map(*[F.lit(x) for pair in fv.RISK_BANDS.items() for x in pair])
    return strategies.select(
        *STRATEGY_COLUMNS,
        lookup(fv.STRATEGY_NOTES, F.col("strategy")).alias("description"),
        (F.col("strategy") == recommended).cast("int").alias("recommended"),
        F.lit(fv.DEFAULT_THRESHOLD).alias("default_threshold"),
        bands.alias("risk_bands"),
    )
