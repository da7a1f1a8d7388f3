"""Queries over the experiment log derived from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import experiments as ex
from riskweave.plans.registry import query, rounded
from riskweave.sources import warehouse

# One row per part and fold; then one row per candidate.
LOG = """
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey // 40 AS VARCHAR) AS run_id,
    CASE WHEN p_partkey % 2 = 0 THEN 'random_forest' ELSE 'boosted_trees' END AS model,
    CAST((p_partkey % 40) // 2 AS INTEGER) AS candidate_id FROM part),
  f AS (SELECT p.*, CAST(t.f AS INTEGER) AS fold, 7000 + (k * 397 + f * 53) % 1500 AS te,
    7000 + (k * 397 + f * 53) % 1500 + (k * 13 + f * 7) % 1300 AS tr,
    ((k * 31 + f * 11) % 900 + 100) / 100.0::DOUBLE AS fit, ((k * 17 + f * 5) % 90 + 10) / 1000.0::DOUBLE AS sco
    FROM p, range(4) t(f)),
  long AS (SELECT run_id, model, candidate_id, fold, 'test' AS split, 'pr_auc' AS metric, te / 10000.0::DOUBLE AS value FROM f
    UNION ALL SELECT run_id, model, candidate_id, fold, 'train', 'pr_auc', tr / 10000.0::DOUBLE FROM f
    UNION ALL SELECT run_id, model, candidate_id, fold, 'test', 'roc_auc', (te + 900) / 10000.0::DOUBLE FROM f
    UNION ALL SELECT run_id, model, candidate_id, fold, 'train', 'roc_auc', (tr + 500) / 10000.0::DOUBLE FROM f),
  c0 AS (SELECT run_id, model, candidate_id, candidate_id * 10 + 10 AS n_estimators, any_value(k) % 3 + 4 AS max_depth,
    round(avg(te / 10000.0::DOUBLE), 12) AS mean_test, round(stddev_pop(te / 10000.0::DOUBLE), 12) AS std_test,
    round(avg(tr / 10000.0::DOUBLE), 12) AS mean_train, round(stddev_pop(tr / 10000.0::DOUBLE), 12) AS std_train,
    round(avg(fit), 12) AS mean_fit_time, round(stddev_pop(fit), 12) AS std_fit_time,
    round(avg(sco), 12) AS mean_score_time, round(stddev_pop(sco), 12) AS std_score_time,
    avg(tr - te) / 10000.0::DOUBLE AS mean_gap FROM f GROUP BY run_id, model, candidate_id),
  c AS (SELECT *, rank() OVER (PARTITION BY run_id, model ORDER BY mean_test DESC) AS rank,
    row_number() OVER (PARTITION BY run_id, model ORDER BY mean_test DESC, candidate_id) AS place FROM c0)
"""


def table(spark, sf, params=False):
    return ex.candidates(warehouse.candidate_log(spark, sf), params=params)


@query(
    "c0_wide_to_long",
    LOG + "SELECT run_id, model, candidate_id, fold, split, metric, round(value, 6) AS value FROM long",
)
def c0(spark, sf):
    wide = ex.wide_from_long(warehouse.candidate_log(spark, sf), ["pr_auc", "roc_auc"], 4)
    return rounded(ex.long_from_wide(wide))


@query(
    "c0_candidate_table",
    LOG
    + """SELECT run_id, model, candidate_id, round(mean_test, 6) AS mean_test, round(std_test, 6) AS std_test,
    round(mean_train, 6) AS mean_train, CAST(rank AS INTEGER) AS rank FROM c""",
)
def c0_table(spark, sf):
    wide = ex.wide_from_long(warehouse.candidate_log(spark, sf), ["pr_auc", "roc_auc"], 4)
    out = ex.candidates_from_wide(wide.drop("params"))
    return rounded(out.select(*ex.ONE, "mean_test", "std_test", "mean_train", "rank"))


@query(
    "c1_top_candidates",
    LOG
    + """SELECT run_id, model, candidate_id, CAST(place AS INTEGER) AS place, CAST(n_estimators AS VARCHAR) AS n_estimators,
    round(mean_test, 6) AS mean_test, round(std_test, 6) AS std_test, round(mean_fit_time, 6) AS mean_fit_time,
    round(mean_score_time, 6) AS mean_score_time FROM c WHERE place <= 5""",
)
def c1(spark, sf):
    top = ex.top_candidates(table(spark, sf, params=True))
    return rounded(
        top.select(
            *ex.ONE,
            "place",
            F.col("params")["n_estimators"].alias("n_estimators"),
            "mean_test",
            "std_test",
            "mean_fit_time",
            "mean_score_time",
        )
    )


@query(
    "c2_spread_summary",
    LOG
    + " UNION ALL ".join(
        f"SELECT run_id, model, '{s}' AS statistic_of, round(avg({s}), 6) AS mean, round(stddev_samp({s}), 6) AS std, "
        f"round(min({s}), 6) AS min, round(max({s}), 6) AS max FROM c GROUP BY 1, 2"
        for s in ex.SCORE_COLUMNS
    ),
)
def c2(spark, sf):
    return rounded(ex.spread_summary(table(spark, sf)))


@query(
    "c3_best_details",
    LOG
    + """, r AS (SELECT run_id, model, round(max(mean_test) - min(mean_test), 12) AS top_range, count(*) AS n_top FROM c
      WHERE place <= 5 GROUP BY 1, 2)
    SELECT c.run_id, c.model, candidate_id, round(mean_test, 6) AS mean_test, round(std_test, 6) AS std_test,
      CASE WHEN std_test < 0.01 THEN 'stable' ELSE 'variable' END AS stability,
      round(1.0::DOUBLE / mean_score_time, 6) AS throughput_estimate, round(top_range, 6) AS top_range,
      CAST(n_top > 1 AND top_range < 0.005 AS INTEGER) AS is_near_tie
    FROM c JOIN r ON c.run_id = r.run_id AND c.model = r.model WHERE place = 1""",
)
def c3(spark, sf):
    return rounded(ex.best_details(table(spark, sf)))


@query(
    "c4_run_statistics",
    LOG
    + """SELECT run_id, model, round(max(CASE WHEN place = 1 THEN mean_test END), 6) AS best_score,
    round(max(CASE WHEN place = 1 THEN std_test END), 6) AS best_std,
    round(max(CASE WHEN place = 1 THEN mean_fit_time END), 6) AS best_fit_time,
    round(max(CASE WHEN place = 1 THEN mean_score_time END), 6) AS best_score_time,
    count(*) AS n_candidates, round(avg(mean_test), 6) AS mean_score_all, round(stddev_samp(mean_test), 6) AS std_score_all
    FROM c GROUP BY 1, 2""",
)
def c4(spark, sf):
    return rounded(ex.run_statistics(table(spark, sf)))


GAPS = """, g AS (SELECT *, round((mean_train - mean_test) / mean_train, 12) AS pct FROM c WHERE place = 1),
  gaps AS (SELECT run_id, model, mean_train, mean_test, mean_train - mean_test AS gap, pct,
    CASE WHEN pct >= 0.1 THEN 'severe' WHEN pct >= 0.05 THEN 'moderate' ELSE 'good' END AS diagnosis FROM g)
"""


@query(
    "c5_best_gap",
    LOG
    + GAPS
    + """SELECT run_id, model, round(mean_train, 6) AS best_train_score, round(mean_test, 6) AS best_val_score,
    round(gap, 6) AS gap, round(pct, 6) AS gap_pct, diagnosis, CAST(diagnosis <> 'good' AS INTEGER) AS overfitting_detected,
    model || ': validation falls short of training by ' || printf('%.1f', round(pct * 100, 1)) || ' % (' || diagnosis || '), ' ||
    CASE diagnosis WHEN 'good' THEN 'keep the settings' WHEN 'moderate' THEN 'try tighter limits on ' || knobs
      ELSE 'set tighter limits on ' || knobs || ' and compare with a simpler model' END AS recommendation
    FROM (SELECT *, CASE model WHEN 'random_forest' THEN 'tree depth and leaf size'
      WHEN 'boosted_trees' THEN 'tree depth, step size and number of rounds' ELSE 'model capacity' END AS knobs FROM gaps)""",
)
def c5(spark, sf):
    return rounded(ex.best_gap(table(spark, sf)))


@query(
    "c6_candidate_gaps",
    LOG
    + """, g AS (SELECT *, round((mean_train - mean_test) / mean_train * 100, 12) AS pct FROM c)
    SELECT run_id, model, candidate_id, CAST(place AS INTEGER) AS place, round(mean_train, 6) AS mean_train,
    round(mean_test, 6) AS mean_test, round(pct, 6) AS gap_pct,
    CASE WHEN pct >= 10 THEN 'severe' WHEN pct >= 5 THEN 'moderate' ELSE 'good' END AS band,
    CAST(rank = 1 AS INTEGER) AS is_best FROM g""",
)
def c6(spark, sf):
    return rounded(ex.candidate_gaps(table(spark, sf)))


CURVE = """, it AS (SELECT *, row_number() OVER (PARTITION BY run_id, model ORDER BY mean_test DESC, n_estimators) AS o FROM c)
"""


@query(
    "c7_iteration_curve",
    LOG
    + CURVE
    + """SELECT run_id, model, CAST(n_estimators AS INTEGER) AS n_estimators, round(mean_train, 6) AS train_score_mean,
    round(std_train, 6) AS train_score_std, round(mean_test, 6) AS val_score_mean, round(std_test, 6) AS val_score_std,
    round(mean_train - mean_test, 6) AS gap, round((mean_train - mean_test) / mean_train * 100, 6) AS gap_pct,
    CAST(o = 1 AS INTEGER) AS is_optimum, CAST(n_estimators = 100 AS INTEGER) AS is_tuned FROM it""",
)
def c7(spark, sf):
    return rounded(ex.iteration_curve(table(spark, sf, params=True), tuned=100))


@query(
    "c8_fold_variation",
    LOG
    + """SELECT run_id, model, round(mean_test, 6) AS mean_score, round(std_test, 6) AS std_score,
    round(std_test / mean_test * 100, 6) AS cv_coef_pct, CASE WHEN std_test / mean_test * 100 > 5 THEN 'high'
    WHEN std_test / mean_test * 100 > 3 THEN 'moderate' ELSE 'low' END AS variation FROM c WHERE place = 1""",
)
def c8(spark, sf):
    return rounded(ex.fold_variation(table(spark, sf)))


@query(
    "c9_normalised_top",
    LOG
    + """, e AS (SELECT run_id, model, min(mean_test) AS sl, max(mean_test) AS sh, min(mean_score_time) AS tl,
      max(mean_score_time) AS th FROM c GROUP BY 1, 2)
    SELECT c.run_id, c.model, candidate_id, CAST(place AS INTEGER) AS place,
      round((mean_test - sl) / (sh - sl + 1e-10::DOUBLE), 6) AS score_normalised,
      round(1.0::DOUBLE - (mean_score_time - tl) / (th - tl + 1e-10::DOUBLE), 6) AS speed_normalised
    FROM c JOIN e ON c.run_id = e.run_id AND c.model = e.model WHERE place <= 5""",
)
def c9(spark, sf):
    return rounded(ex.normalised_top(table(spark, sf)))


@query(
    "c10_suggested_range",
    LOG
    + CURVE
    + """SELECT run_id, model, CAST(greatest(10, n_estimators - 20) AS INTEGER) AS low,
    CAST(n_estimators AS INTEGER) AS middle, CAST(n_estimators + 20 AS INTEGER) AS high FROM it WHERE o = 1""",
)
def c10(spark, sf):
    return ex.suggested_range(ex.iteration_curve(table(spark, sf, params=True)))


@query(
    "c11_run_verdict",
    LOG
    + GAPS
    + """, w AS (SELECT run_id, (array_agg(model ORDER BY mean_test DESC, model DESC))[1] AS better_model,
      max(mean_test) AS better_score, count(*) FILTER (diagnosis <> 'good') AS n_overfit, count(*) AS n_models,
      max(CASE WHEN diagnosis = 'good' THEN model END) AS clean FROM gaps GROUP BY run_id)
    SELECT run_id, better_model, round(better_score, 6) AS better_score, n_overfit,
      CASE WHEN n_overfit = 0 THEN 'all generalise well' WHEN n_overfit = n_models THEN 'all overfit, regularise more'
      ELSE 'prefer ' || clean || ', the other overfits' END AS verdict FROM w""",
)
def c11(spark, sf):
    return rounded(ex.run_verdict(ex.best_gap(table(spark, sf))))


DIAGNOSED = """, d AS (SELECT *, CASE WHEN round(mean_gap, 12) > 0.15 THEN 'high variance, severe'
    WHEN round(mean_gap, 12) > 0.1 THEN 'high variance, moderate'
    WHEN mean_train < 0.3 AND mean_test < 0.3 THEN 'high bias' ELSE 'good fit' END AS diagnosis FROM c)
"""


@query(
    "m13_gap_diagnosis",
    LOG
    + DIAGNOSED
    + """SELECT run_id, model, candidate_id, round(mean_train, 6) AS train_mean, round(std_train, 6) AS train_std,
    round(mean_test, 6) AS val_mean, round(std_test, 6) AS val_std, round(mean_gap, 6) AS mean_gap,
    round(mean_train - mean_test, 6) AS gap, round((mean_train - mean_test) / mean_train * 100, 6) AS gap_pct, diagnosis
    FROM d""",
)
def m13(spark, sf):
    return rounded(ex.gap_diagnosis(ex.fold_gaps(warehouse.candidate_log(spark, sf))))


@query(
    "c11_diagnosis_lines",
    LOG
    + DIAGNOSED
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mean_test DESC, model, candidate_id) AS o FROM d)
    SELECT run_id, model, candidate_id, diagnosis, CASE WHEN diagnosis LIKE 'high variance%'
      THEN 'overfitting: regularise, stop early or add data' WHEN diagnosis = 'high bias'
      THEN 'underfitting: richer model or better features' ELSE 'good bias-variance trade-off' END AS advice,
      CAST(o = 1 AS INTEGER) AS is_best FROM b""",
)
def c11_lines(spark, sf):
    lines = ex.diagnosis_lines(ex.gap_diagnosis(ex.fold_gaps(warehouse.candidate_log(spark, sf))))
    return lines.select(*ex.ONE, "diagnosis", "advice", "is_best")


@query(
    "m9_best_metric_means",
    LOG
    + """SELECT run_id, model, candidate_id, metric, round(avg(value), 6) AS mean_value FROM long JOIN
    (SELECT run_id, model, candidate_id FROM c WHERE place = 1) USING (run_id, model, candidate_id)
    WHERE split = 'test' GROUP BY 1, 2, 3, 4""",
)
def m9(spark, sf):
    return rounded(ex.best_metric_means(warehouse.candidate_log(spark, sf)))


@query(
    "m9_best_parameters",
    LOG
    + """SELECT run_id, model, 'n_estimators' AS name, CAST(n_estimators AS VARCHAR) AS value FROM c WHERE place = 1
    UNION ALL SELECT run_id, model, 'max_depth', CAST(max_depth AS VARCHAR) FROM c WHERE place = 1""",
)
def m9_parameters(spark, sf):
    return ex.best_parameters(table(spark, sf, params=True))
