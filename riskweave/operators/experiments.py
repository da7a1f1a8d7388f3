"""Analytics over experiment logs.

The stored form is long: one value per run, model, candidate, fold, split and metric.
``candidates`` turns it into one row per candidate; everything else works on that table.
A run holds as many candidates as its grid, so windows per (run, model) stay small.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import banded, lookup, stacked

RUN = ["run_id", "model"]
ONE = [*RUN, "candidate_id"]
SCORE_COLUMNS = ["mean_test", "std_test", "mean_fit_time", "std_fit_time", "mean_score_time", "std_score_time"]
DIGITS = 12  # means are rounded here, so the order of the folds never decides a rank


def _mean(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, F.col("value"))), DIGITS)


def _std(condition: Column) -> Column:
    return F.round(F.stddev_pop(F.when(condition, F.col("value"))), DIGITS)


def with_params(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``rows`` (one per candidate) with the candidate's parameters from ``log``.

    A map among the aggregates would sort all rows of the log by candidate; its entries as a key are hashed, so that a task
    keeps one entry for each candidate, and only these are sorted.
    """
    own = [F.col(c).alias(f"_{c}") for c in ONE]
    entries = F.array_sort(F.map_entries("params")).alias("_entries")
    each = log.filter(F.col("params").isNotNull()).select(*own, entries).distinct()
    first = each.groupBy(*[f"_{c}" for c in ONE]).agg(F.map_from_entries(F.first("_entries")).alias("params"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ONE]
    found = rows.join(first, functools.reduce(Column.__and__, same), "left")
    return found.select(*ONE, "params", *[c for c in rows.columns if c not in ONE])


def candidates(log: DataFrame, metric: str = "pr_auc", params: bool = True) -> DataFrame:
    """One row per candidate: mean and population deviation over folds, times, parameters (if asked for), rank."""
    test = (F.col("metric") == metric) & (F.col("split") == "test")
    train = (F.col("metric") == metric) & (F.col("split") == "train")
    fit, score = F.col("metric") == "fit_time", F.col("metric") == "score_time"
    rows = log.groupBy(*ONE).agg(
        _mean(test).alias("mean_test"),
        _std(test).alias("std_test"),
        _mean(train).alias("mean_train"),
        _std(train).alias("std_train"),
        _mean(fit).alias("mean_fit_time"),
        _std(fit).alias("std_fit_time"),
        _mean(score).alias("mean_score_time"),
        _std(score).alias("std_score_time"),
    )
    rows = with_params(rows, log) if params else rows
    order = Window.partitionBy(*RUN).orderBy(F.col("mean_test").desc_nulls_last())
    return rows.withColumn("rank", F.rank().over(order))


# ---- wide form -------------------------------------------------------------------

_FOLD_COLUMN = re.compile(r"split(\d+)_(test|train)_(.+)")
PARAM_PREFIXES = re.compile(r"^(param_)?(classifier__)?")


def clean_param(name: str) -> str:
    return PARAM_PREFIXES.sub("", name)


def score_column(columns: Sequence[str], metric: str | None, kind: str = "mean_test") -> str:
    """Name of a score column: the metric's own if the log has it, else the single-metric one."""
    wanted = f"{kind}_{metric}"
    return wanted if metric and f"mean_test_{metric}" in columns else f"{kind}_score"


def candidates_from_wide(wide: DataFrame, metric: str | None = "pr_auc") -> DataFrame:
    """Candidate table from a wide log (one row per candidate, one column per statistic).

    Columns the log lacks (train scores, times, ids) stay out or become constants.
    """
    have = wide.columns
    pick = {
        "mean_test": score_column(have, metric),
        "std_test": score_column(have, metric, "std_test"),
        "mean_train": score_column(have, metric, "mean_train"),
        "std_train": score_column(have, metric, "std_train"),
        "rank": score_column(have, metric, "rank_test"),
        **{c: c for c in SCORE_COLUMNS[2:]},
    }
    if pick["mean_test"] not in have:
        raise ValueError(f"no score column {pick['mean_test']!r} in the log")
    params = [c for c in have if c.startswith("param_")]
    # candidates are numbered by their parameters, so the numbering does not depend on file order
    number = Window.partitionBy(*[F.col(c) for c in RUN if c in have] or [F.lit(0)]).orderBy(
        F.col(pick["rank"]) if pick["rank"] in have else F.col(pick["mean_test"]).desc(), *[F.col(c) for c in params]
    )
    rows = wide.select(
        *[F.col(c) if c in have else F.lit("all").alias(c) for c in RUN],
        (F.col("candidate_id") if "candidate_id" in have else F.row_number().over(number) - 1).alias("candidate_id"),
        (
            F.create_map(*[x for c in params for x in (F.lit(clean_param(c)), F.col(c).cast("string"))])
            if params
            else F.lit(None).cast("map<string,string>")
        ).alias("params"),
        *[F.col(source).cast("double").alias(name) for name, source in pick.items() if source in have and name != "rank"],
    )
    order = Window.partitionBy(*RUN).orderBy(F.col("mean_test").desc_nulls_last())
    return rows.withColumn("rank", F.rank().over(order))


def long_from_wide(wide: DataFrame, ids: Sequence[str] = tuple(ONE)) -> DataFrame:
    """Per-fold scores of a wide log as long rows (ids..., fold, split, metric, value)."""
    matches = [(c, _FOLD_COLUMN.fullmatch(c)) for c in wide.columns]
    cells = [
        F.struct(
            F.lit(int(m[1])).alias("fold"),
            F.lit(m[2]).alias("split"),
            F.lit(m[3]).alias("metric"),
            F.col(c).cast("double").alias("value"),
        )
        for c, m in matches
        if m
    ]
    if not cells:
        raise ValueError("the log has no per-fold score columns")
    return wide.select(*ids, F.explode(F.array(*cells)).alias("cell")).select(*ids, "cell.*")


def wide_from_long(log: DataFrame, metrics: Sequence[str], folds: int) -> DataFrame:
    """Wide form of a long log: per-fold columns, means, deviations and ranks per metric."""
    aggregates = []
    for m in metrics:
        for s in ("test", "train"):
            hit = (F.col("metric") == m) & (F.col("split") == s)
            for f in range(folds):
                aggregates.append(
                    F.max(F.when(hit & (F.col("fold") == f), F.col("value"))).alias(f"split{f}_{s}_{m}")
                )
            aggregates += [_mean(hit).alias(f"mean_{s}_{m}"), _std(hit).alias(f"std_{s}_{m}")]
    for t in ("fit_time", "score_time"):
        aggregates += [_mean(F.col("metric") == t).alias(f"mean_{t}"), _std(F.col("metric") == t).alias(f"std_{t}")]
    wide = with_params(log.groupBy(*ONE).agg(*aggregates), log)
    return wide.withColumns(
        {
            f"rank_test_{m}": F.rank().over(
                Window.partitionBy(*RUN).orderBy(F.col(f"mean_test_{m}").desc_nulls_last())
            )
            for m in metrics
        }
    )


# ---- reports over the candidate table ---------------------------------------------


def _ordered() -> Window:
    return Window.partitionBy(*RUN).orderBy(F.col("mean_test").desc_nulls_last(), "candidate_id")


def top_candidates(table: DataFrame, top_n: int = 5) -> DataFrame:
    return table.withColumn("place", F.row_number().over(_ordered())).filter(F.col("place") <= top_n)


def best_candidates(table: DataFrame) -> DataFrame:
    return top_candidates(table, 1).drop("place")


def spread_summary(table: DataFrame) -> DataFrame:
    """Mean, sample deviation, min and max over candidates of every score and time column."""
    columns = [c for c in SCORE_COLUMNS if c in table.columns]
    sums = table.groupBy(*RUN).agg(
        *[
            f(c).alias(f"{n}_{c}")
            for c in columns
            for n, f in (("avg", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        ]
    )
    rows = [[F.lit(c), *[F.col(f"{n}_{c}") for n in ("avg", "sd", "lo", "hi")]] for c in columns]
    return sums.select(*RUN, stacked(rows, ["statistic_of", "mean", "std", "min", "max"])).select(*RUN, "row.*")


def best_details(table: DataFrame, top_n: int = 5, stable_below: float = 0.01, near_tie: float = 0.005) -> DataFrame:
    """Best candidate with stability, throughput estimate and whether the top ones nearly tie."""
    top = top_candidates(table, top_n)
    ranges = top.groupBy(*RUN).agg(
        (F.max("mean_test") - F.min("mean_test")).alias("top_range"), F.count(F.lit(1)).alias("n_top")
    )
    return (
        top.filter("place = 1")
        .join(ranges, RUN)
        .select(
            *ONE,
            "mean_test",
            "std_test",
            F.when(F.col("std_test") < stable_below, "stable").otherwise("variable").alias("stability"),
            F.when(F.col("mean_score_time") > 0, F.lit(1.0) / F.col("mean_score_time")).alias("throughput_estimate"),
            F.round("top_range", DIGITS).alias("top_range"),
            ((F.col("n_top") > 1) & (F.round("top_range", DIGITS) < near_tie)).cast("int").alias("is_near_tie"),
        )
    )


def run_statistics(table: DataFrame) -> DataFrame:
    """Best score with its deviation and times; count, mean and sample deviation of all candidates."""
    everyone = table.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.avg("mean_test").alias("mean_score_all"),
        F.stddev_samp("mean_test").alias("std_score_all"),
    )
    best = best_candidates(table).select(
        *RUN,
        F.col("mean_test").alias("best_score"),
        F.col("std_test").alias("best_std"),
        F.col("mean_fit_time").alias("best_fit_time"),
        F.col("mean_score_time").alias("best_score_time"),
    )
    return best.join(everyone, RUN)


def require_train_scores(table: DataFrame) -> None:
    if "mean_train" not in table.columns:
        raise ValueError("the log has no training scores; run the search with train scores kept")


def _gap_pct() -> Column:
    gap = F.col("mean_train") - F.col("mean_test")
    return F.when(F.col("mean_train") > 0, gap / F.col("mean_train")).otherwise(F.lit(0.0))


# What limits the capacity of each family's learner here; any other family is named only in general.
CAPACITY = {"random_forest": "tree depth and leaf size", "boosted_trees": "tree depth, step size and number of rounds"}


def _advice(severity: Column, gap_pct: Column) -> Column:
    """Model, gap in percent of the train score, and what to limit."""
    knobs = F.coalesce(lookup(CAPACITY, F.col("model")), F.lit("model capacity"))
    action = (
        F.when(severity == "good", F.lit("keep the settings"))
        .when(severity == "moderate", F.concat(F.lit("try tighter limits on "), knobs))
        .otherwise(F.concat(F.lit("set tighter limits on "), knobs, F.lit(" and compare with a simpler model")))
    )
    gap = F.format_string("%.1f", F.round(gap_pct * 100, 1))
    return F.concat(F.col("model"), F.lit(": validation falls short of training by "), gap, F.lit(" % ("), severity, F.lit("), "), action)


def best_gap(table: DataFrame, moderate: float = 0.05, severe: float = 0.10) -> DataFrame:
    """Train-validation gap of each run's best candidate, relative to the train score, with advice."""
    require_train_scores(table)
    rows = best_candidates(table).select(
        *RUN,
        F.col("mean_train").alias("best_train_score"),
        F.col("mean_test").alias("best_val_score"),
        (F.col("mean_train") - F.col("mean_test")).alias("gap"),
        _gap_pct().alias("gap_pct"),
    )
    level = banded(F.round("gap_pct", DIGITS), [(severe, "severe"), (moderate, "moderate")], "good")
    return rows.withColumns(
        {
            "diagnosis": level,
            "overfitting_detected": (level != "good").cast("int"),
            "recommendation": _advice(level, F.col("gap_pct")),
        }
    )


def candidate_gaps(table: DataFrame) -> DataFrame:
    """Gap of every candidate in percent of its train score, best validation score first."""
    require_train_scores(table)
    percent = F.round(_gap_pct() * 100, DIGITS)
    return table.select(
        *ONE,
        F.row_number().over(_ordered()).alias("place"),
        "mean_train",
        "mean_test",
        percent.alias("gap_pct"),
        banded(percent, [(10.0, "severe"), (5.0, "moderate")], "good").alias("band"),
        (F.col("rank") == 1).cast("int").alias("is_best"),
    )


def iteration_curve(table: DataFrame, param: str = "n_estimators", tuned: int | None = None) -> DataFrame:
    """Scores along one integer parameter, with the optimum (lowest value on ties) and the tuned value marked."""
    require_train_scores(table)
    n = F.col("params")[param].cast("double").cast("int")
    rows = table.filter(n.isNotNull()).select(
        *RUN,
        n.alias(param),
        F.col("mean_train").alias("train_score_mean"),
        F.coalesce("std_train", F.lit(0.0)).alias("train_score_std"),
        F.col("mean_test").alias("val_score_mean"),
        F.coalesce("std_test", F.lit(0.0)).alias("val_score_std"),
        (F.col("mean_train") - F.col("mean_test")).alias("gap"),
        (_gap_pct() * 100).alias("gap_pct"),
    )
    first = Window.partitionBy(*RUN).orderBy(F.col("val_score_mean").desc_nulls_last(), F.col(param))
    return rows.withColumns(
        {
            "is_optimum": (F.row_number().over(first) == 1).cast("int"),
            "is_tuned": (F.col(param) == F.lit(tuned)).cast("int") if tuned is not None else F.lit(0),
        }
    )


def suggested_range(curve: DataFrame, param: str = "n_estimators", step: int = 20, floor: int = 10) -> DataFrame:
    n = F.col(param)
    return curve.filter("is_optimum = 1").select(
        *RUN, F.greatest(F.lit(floor), n - step).alias("low"), n.alias("middle"), (n + step).alias("high")
    )


def fold_variation(table: DataFrame) -> DataFrame:
    """Deviation over folds in percent of the mean, of each run's best candidate."""
    percent = F.when(F.col("mean_test") > 0, F.col("std_test") / F.col("mean_test") * 100).otherwise(F.lit(0.0))
    return best_candidates(table).select(
        *RUN,
        F.col("mean_test").alias("mean_score"),
        F.col("std_test").alias("std_score"),
        percent.alias("cv_coef_pct"),
        banded(percent, [(5.0, "high"), (3.0, "moderate")], "low", strict=True).alias("variation"),
    )


def normalised_top(table: DataFrame, top_n: int = 5, epsilon: float = 1e-10) -> DataFrame:
    """Score scaled to 0-1 and speed (inverted time) scaled to 0-1, over the run's range, for the top ones."""
    ends = table.groupBy(*RUN).agg(
        F.min("mean_test").alias("s_lo"),
        F.max("mean_test").alias("s_hi"),
        F.min("mean_score_time").alias("t_lo"),
        F.max("mean_score_time").alias("t_hi"),
    )
    score = (F.col("mean_test") - F.col("s_lo")) / (F.col("s_hi") - F.col("s_lo") + F.lit(epsilon))
    speed = F.lit(1.0) - (F.col("mean_score_time") - F.col("t_lo")) / (
        F.col("t_hi") - F.col("t_lo") + F.lit(epsilon)
    )
    return (
        top_candidates(table, top_n)
        .join(ends, RUN)
        .select(*ONE, "place", score.alias("score_normalised"), speed.alias("speed_normalised"))
    )


def run_verdict(gaps: DataFrame) -> DataFrame:
    """Per run: better model by validation score, and which models overfit.

    Equal scores go to the model first by name in reverse, so a forest is kept over boosted trees.
    """
    both = gaps.groupBy("run_id").agg(
        F.max(F.struct("best_val_score", "model")).alias("top"),
        F.sum("overfitting_detected").alias("n_overfit"),
        F.count(F.lit(1)).alias("n_models"),
        F.max(F.when(F.col("overfitting_detected") == 0, F.struct("best_val_score", "model"))).alias("clean"),
    )
    verdict = (
        F.when(F.col("n_overfit") == 0, F.lit("all generalise well"))
        .when(F.col("n_overfit") == F.col("n_models"), F.lit("all overfit, regularise more"))
        .otherwise(F.concat(F.lit("prefer "), F.col("clean.model"), F.lit(", the other overfits")))
    )
    return both.select(
        "run_id",
        F.col("top.model").alias("better_model"),
        F.col("top.best_val_score").alias("better_score"),
        "n_overfit",
        verdict.alias("verdict"),
    )


# ---- fold-level gap diagnosis ----------------------------------------------------------


def fold_gaps(log: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Train, validation and gap per fold: (run_id, model, candidate_id, fold, train, validation, gap)."""
    value = lambda split: F.max(F.when(F.col("split") == split, F.col("value")))
    return (
        log.filter(F.col("metric") == metric)
        .groupBy(*ONE, "fold")
        .agg(value("train").alias("train"), value("test").alias("validation"))
        .withColumn("gap", F.col("train") - F.col("validation"))
    )


def gap_diagnosis(per_fold: DataFrame, severe: float = 0.15, moderate: float = 0.10, weak: float = 0.3) -> DataFrame:
    """Mean gap over folds judged on absolute limits; both scores low means underfitting."""
    rows = per_fold.groupBy(*ONE).agg(
        F.round(F.avg("train"), DIGITS).alias("train_mean"),
        F.round(F.stddev_pop("train"), DIGITS).alias("train_std"),
        F.round(F.avg("validation"), DIGITS).alias("val_mean"),
        F.round(F.stddev_pop("validation"), DIGITS).alias("val_std"),
        F.round(F.avg("gap"), DIGITS).alias("mean_gap"),
    )
    diagnosis = (
        F.when(F.col("mean_gap") > severe, F.lit("high variance, severe"))
        .when(F.col("mean_gap") > moderate, F.lit("high variance, moderate"))
        .when((F.col("train_mean") < weak) & (F.col("val_mean") < weak), F.lit("high bias"))
        .otherwise(F.lit("good fit"))
    )
    gap = F.col("train_mean") - F.col("val_mean")
    return rows.withColumns(
        {
            "gap": F.round(gap, DIGITS),
            "gap_pct": F.when(F.col("train_mean") > 0, gap / F.col("train_mean") * 100),
            "diagnosis": diagnosis,
        }
    )


def diagnosis_lines(diagnosed: DataFrame) -> DataFrame:
    """One advice line per model, with the best model by validation score marked."""
    best = Window.partitionBy("run_id").orderBy(F.col("val_mean").desc(), F.col("model"), F.col("candidate_id"))
    advice = (
        F.when(F.col("diagnosis").startswith("high variance"), F.lit("overfitting: regularise, stop early or add data"))
        .when(F.col("diagnosis") == "high bias", F.lit("underfitting: richer model or better features"))
        .otherwise(F.lit("good bias-variance trade-off"))
    )
    return diagnosed.withColumns(
        {"advice": advice, "is_best": (F.row_number().over(best) == 1).cast("int")}
    )


# ---- best candidate over all metrics ---------------------------------------------------


def best_metric_means(log: DataFrame, refit: str = "pr_auc") -> DataFrame:
    """Mean test value of every metric for each run's best candidate by ``refit``."""
    best = best_candidates(candidates(log, refit, params=False)).select(*ONE)
    scores = log.filter(F.col("split") == "test").groupBy(*ONE, "metric").agg(
        F.round(F.avg("value"), DIGITS).alias("mean_value")
    )
    return scores.join(best, ONE)


def best_parameters(table: DataFrame) -> DataFrame:
    """Parameters of each run's best candidate as (run_id, model, name, value) rows, prefixes removed."""
    rows = best_candidates(table).select(*RUN, F.explode("params").alias("name", "value"))
    return rows.withColumn("name", F.regexp_replace("name", PARAM_PREFIXES.pattern, ""))
