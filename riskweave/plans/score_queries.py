"""Queries: evaluation, thresholds, explanation records, decisions and the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import curves, importance, metrics, scoring, thresholds
from riskweave.operators.features import FittedStatistics, engineered
from riskweave.operators.request_log import latency_summary
from riskweave.plans.feature_queries import featured_sql
from riskweave.plans.registry import query, rounded, tx
from riskweave.sources import warehouse
from riskweave.sources.scratch import scratch_path

CURVE = """, counts AS (SELECT score, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg
    FROM scored GROUP BY score),
  tot AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scored),
  cum AS (SELECT score AS threshold, n_pos, n_neg, p, q,
      CAST(sum(n_pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
      CAST(sum(n_neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
      row_number() OVER (ORDER BY score) - 1 AS position, count(*) OVER () AS n_points FROM counts, tot),
  curve AS (SELECT *, p - tp AS fn, q - fp AS tn, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall FROM cum),
  pts AS (SELECT *, 2.0::DOUBLE * precision * recall / (precision + recall + 1e-10::DOUBLE) AS f1s,
      CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * (precision * recall) / (precision + recall) ELSE 0 END AS f1e
      FROM curve)
"""


def pick_sql(name: str, goal: str, where: str = "true", f1: str = "f1e", target: str = "NULL", floor: str = "NULL") -> str:
    return (
        f"(SELECT '{name}' AS strategy, threshold, precision, recall, {f1} AS f1, CAST({target} AS DOUBLE) AS target_recall, "
        f"CAST({floor} AS DOUBLE) AS min_precision, tp, fp, tn, fn FROM pts WHERE {where} "
        f"ORDER BY {goal} DESC, threshold LIMIT 1)"
    )


OPTIMAL = pick_sql("optimal_f1", "f1s", f1="f1s")
TARGET = pick_sql("target_performance", "recall", "precision >= 0.7", floor="0.7")
RECALLS = [pick_sql(n, "precision", f"recall >= {t}", target=str(t)) for n, t in fv.RECALL_TARGETS.items()]
STRATEGIES = CURVE + ", strategies AS (" + " UNION ALL ".join([OPTIMAL, TARGET, *RECALLS]) + ")\n"


def curve(spark, sf):
    return curves.curve_of(warehouse.scored(spark, sf))


# ---- thresholds --------------------------------------------------------------------


@query(
    "t1_threshold_curve",
    tx(CURVE + "SELECT threshold, n_pos, n_neg, tp, fp, fn, tn, precision, recall, position, n_points FROM curve"),
)
def t1(spark, sf):
    return curve(spark, sf)


@query(
    "t1_threshold_curve_many_ranges",
    tx(CURVE + "SELECT threshold, n_pos, n_neg, tp, fp, fn, tn, precision, recall, position, n_points FROM curve"),
)
def t1_ranges(spark, sf):
    """The same curve forced through many small ranges, as on large data."""
    return curves.threshold_curve(curves.score_counts(warehouse.scored(spark, sf)), rows_per_range=40)


@query("t2_optimal_f1", tx(CURVE + OPTIMAL))
def t2(spark, sf):
    return thresholds.optimal_f1_threshold(curve(spark, sf))


@query("t3_recall_thresholds", tx(CURVE + " UNION ALL ".join(RECALLS)))
def t3(spark, sf):
    return thresholds.recall_thresholds(curve(spark, sf))


@query("t4_precision_threshold", tx(CURVE + TARGET))
def t4(spark, sf):
    return thresholds.precision_threshold(curve(spark, sf))


@query(
    "t5_nearest_recall",
    tx(
        CURVE
        + ", ends AS (SELECT threshold, precision, recall, f1e, 0 AS is_end FROM pts UNION ALL "
        + "SELECT (SELECT max(threshold) FROM pts), 1.0, 0.0, 0.0, 1)"
        + " UNION ALL ".join(
            [
                "SELECT 'optimal_f1' AS strategy, CAST(NULL AS DOUBLE) AS target_recall, threshold, precision, recall, f1 "
                f"FROM {OPTIMAL}"
            ]
            + [
                f"(SELECT '{n}' AS strategy, CAST({t} AS DOUBLE) AS target_recall, threshold, precision, recall, f1e AS f1 "
                f"FROM ends ORDER BY abs(recall - {t}::DOUBLE), is_end, threshold LIMIT 1)"
                for n, t in {**fv.RECALL_TARGETS, "tiny": 0.001}.items()
            ]
        )
    ),
)
def t5(spark, sf):
    return thresholds.nearest_recall_thresholds(curve(spark, sf), {**fv.RECALL_TARGETS, "tiny": 0.001})


@query("t6_all_strategies", tx(STRATEGIES + "SELECT * FROM strategies"))
def t6(spark, sf):
    return thresholds.all_strategies(curve(spark, sf))


@query(
    "t7_error_rates",
    tx(STRATEGIES + "SELECT strategy, fp / (fp + tn)::DOUBLE AS fpr, fn / (fn + tp)::DOUBLE AS fnr FROM strategies"),
)
def t7(spark, sf):
    return thresholds.with_error_rates(thresholds.all_strategies(curve(spark, sf))).select("strategy", "fpr", "fnr")


@query(
    "t8_comparison_table",
    tx(
        STRATEGIES
        + """SELECT CASE strategy WHEN 'optimal_f1' THEN 'Optimal F1 (Best Balance)'
      WHEN 'target_performance' THEN 'Target Performance (>=70% Prec)'
      WHEN 'conservative_90pct_recall' THEN 'Conservative (90% Recall)'
      WHEN 'balanced_85pct_recall' THEN 'Balanced (85% Recall)' ELSE 'Aggressive (80% Recall)' END AS strategy,
      threshold, precision, recall, f1, fp, fn FROM strategies"""
    ),
)
def t8(spark, sf):
    return thresholds.comparison_table(thresholds.all_strategies(curve(spark, sf)))


@query(
    "t9_sampled_sweep",
    tx(
        CURVE
        + """SELECT threshold, precision, recall, f1s AS f1 FROM pts
    WHERE position % greatest(1, n_points // 1000) = 0"""
    ),
)
def t9(spark, sf):
    return curves.sampled_sweep(curve(spark, sf))


CUSTOM = {"catch_most": 0.95, "half": 0.5, "few": 0.25}


@query(
    "t10_custom_targets",
    tx(CURVE + " UNION ALL ".join(pick_sql(n, "precision", f"recall >= {t}", target=str(t)) for n, t in CUSTOM.items())),
)
def t10(spark, sf):
    return thresholds.recall_thresholds(curve(spark, sf), CUSTOM)


@query(
    "sc5_strategy_artifact",
    tx(
        STRATEGIES
        + """SELECT strategy, threshold, tp, fp, tn, fn, CAST(strategy = 'target_performance' AS INTEGER) AS recommended,
      0.5::DOUBLE AS default_threshold, 0.3::DOUBLE AS low_below, 0.7::DOUBLE AS medium_below FROM strategies"""
    ),
)
def sc5(spark, sf):
    path = scratch_path(spark, "strategies")
    thresholds.strategy_artifact(thresholds.all_strategies(curve(spark, sf))).coalesce(1).write.parquet(path)
    return spark.read.parquet(path).select(
        "strategy",
        "threshold",
        "tp",
        "fp",
        "tn",
        "fn",
        "recommended",
        "default_threshold",
        F.col("risk_bands")["low"].alias("low_below"),
        F.col("risk_bands")["medium"].alias("medium_below"),
    )


# ---- evaluation ----------------------------------------------------------------------

TWO = """, two AS (
    SELECT 'boosted_trees' AS model, transaction_id, label, score,
           CASE WHEN transaction_id % 4 = 0 THEN 'test' ELSE 'validation' END AS dataset FROM scored
    UNION ALL
    SELECT 'random_forest', transaction_id, label,
           least(999, (transaction_id * 104729 % 1000) * 8 // 10 + 150 * label) / 1000.0::DOUBLE,
           CASE WHEN transaction_id % 4 = 0 THEN 'test' ELSE 'validation' END FROM scored),
  c2 AS (SELECT model, dataset, score, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg
         FROM two GROUP BY 1, 2, 3),
  k2 AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER g AS p, sum(n_neg) OVER g AS q
         FROM c2 WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC), g AS (PARTITION BY model, dataset)),
  rank2 AS (SELECT model, dataset, sum(tp / (tp + fp)::DOUBLE * n_pos) / any_value(p) AS pr_auc,
         sum(n_neg * (tp - n_pos / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(q)) AS roc_auc FROM k2 GROUP BY 1, 2),
  cm2 AS (SELECT model, dataset, count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
         count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
         count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM two GROUP BY 1, 2),
  eval2 AS (SELECT model, dataset, pr_auc, roc_auc,
         CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
         (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, tp, fp, tn, fn
         FROM rank2 JOIN cm2 USING (model, dataset))
"""


def evaluated(spark, sf):
    return metrics.evaluate(warehouse.two_model_scores(spark, sf), ["model", "dataset"])


@query(
    "e1_average_precision",
    tx(CURVE + "SELECT round(sum(precision * n_pos) / any_value(p), 6) AS pr_auc FROM curve"),
)
def e1(spark, sf):
    return rounded(curves.ranking_metrics(curve(spark, sf)).select("pr_auc"))


@query(
    "e2_roc_auc",
    tx("""SELECT round(sum(CASE WHEN label = 1 THEN r ELSE 0 END) / (any_value(p)::DOUBLE * any_value(q))
       - (any_value(p) + 1) / (2.0::DOUBLE * any_value(q)), 6) AS roc_auc FROM (
    SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) AS r,
      count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label = 0) OVER () AS q FROM scored)"""),
)
def e2(spark, sf):
    return rounded(curves.ranking_metrics(curve(spark, sf)).select("roc_auc"))


CONFUSION = """, cm AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
    count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
    count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored)
"""


@query(
    "e3_threshold_metrics",
    tx(
        CONFUSION
        + """SELECT tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
    2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM cm"""
    ),
)
def e3(spark, sf):
    counts = metrics.confusion(warehouse.scored(spark, sf))
    return metrics.with_threshold_metrics(counts).select("precision", "recall", "f1", "accuracy")


@query("e4_confusion", tx(CONFUSION + "SELECT tp, fp, tn, fn FROM cm"))
def e4(spark, sf):
    return metrics.confusion(warehouse.scored(spark, sf))


@query(
    "e5_evaluate_models",
    tx(
        TWO
        + """SELECT model, dataset, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(f1, 6) AS f1,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, tp, fp, tn, fn FROM eval2"""
    ),
)
def e5(spark, sf):
    return rounded(evaluated(spark, sf))


@query(
    "e6_roc_points",
    tx(
        CURVE
        + """SELECT threshold, fp / q::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM curve
    UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""
    ),
)
def e6(spark, sf):
    return curves.roc_points(warehouse.scored(spark, sf))


@query(
    "e6_roc_points_thinned",
    tx(
        CURVE
        + """, d AS (SELECT *, lead(n_pos) OVER (ORDER BY threshold DESC) AS np, lead(n_neg) OVER (ORDER BY threshold DESC) AS nn
      FROM curve)
    SELECT threshold, fp / q::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM d
      WHERE np IS NULL OR np <> n_pos OR nn <> n_neg
    UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""
    ),
)
def e6_thin(spark, sf):
    return curves.roc_points(warehouse.scored(spark, sf), drop_collinear=True, rows_per_range=40)


@query(
    "e7_compare_models",
    tx(
        TWO
        + """SELECT model, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(recall, 6) AS recall
    FROM eval2 WHERE dataset = 'validation'"""
    ),
)
def e7(spark, sf):
    validation = evaluated(spark, sf).filter("dataset = 'validation'")
    return rounded(metrics.compare_models(validation, ["pr_auc", "roc_auc", "recall", "brier"]))


@query(
    "e8_best_per_metric",
    tx(
        TWO
        + " UNION ALL ".join(
            f"(SELECT '{m}' AS metric, model, round({m}, 6) AS value FROM eval2 WHERE dataset = 'validation' "
            f"ORDER BY {m} DESC, model LIMIT 1)"
            for m in fv.METRICS
        )
    ),
)
def e8(spark, sf):
    validation = evaluated(spark, sf).filter("dataset = 'validation'")
    return rounded(metrics.best_per_metric(metrics.compare_models(validation, fv.METRICS)))


@query(
    "e8_best_model",
    tx(
        TWO
        + """SELECT model, round(pr_auc, 6) AS pr_auc, round(f1, 6) AS f1 FROM eval2
    WHERE dataset = 'validation' ORDER BY eval2.pr_auc DESC, model LIMIT 1"""
    ),
)
def e8_model(spark, sf):
    validation = evaluated(spark, sf).filter("dataset = 'validation'")
    return rounded(metrics.best_model(metrics.compare_models(validation, ["pr_auc", "f1"]), "pr_auc"))


FIVE = ["roc_auc", "pr_auc", "f1", "precision", "recall"]


@query(
    "e9_validation_vs_test",
    tx(
        TWO
        + ", long2 AS ("
        + " UNION ALL ".join(f"SELECT model, dataset, '{m}' AS metric, {m} AS value FROM eval2" for m in FIVE)
        + """), d AS (SELECT v.model, v.metric, v.value AS validation, t.value AS test, t.value - v.value AS diff,
        (t.value - v.value) / v.value * 100 AS pct FROM long2 v JOIN long2 t ON v.model = t.model AND v.metric = t.metric
        AND v.dataset = 'validation' AND t.dataset = 'test'),
      b AS (SELECT *, CASE WHEN abs(pct) >= 5 THEN 'concerning' WHEN abs(pct) >= 2 THEN 'acceptable'
        WHEN abs(pct) >= 1 THEN 'good' ELSE 'excellent' END AS status FROM d)
      SELECT b.model, b.metric, round(b.validation, 6) AS validation, round(b.test, 6) AS test, round(b.diff, 6) AS diff,
        round(b.pct, 6) AS diff_pct, b.status, m.status AS generalisation,
        CAST(m.test >= m.validation * 0.98::DOUBLE AS INTEGER) AS is_consistent
      FROM b JOIN b m ON b.model = m.model AND m.metric = 'pr_auc'"""
    ),
)
def e9(spark, sf):
    both = evaluated(spark, sf)
    return rounded(
        metrics.validation_vs_test(both.filter("dataset = 'validation'"), both.filter("dataset = 'test'"))
    )


@query(
    "e10_tuning_change",
    tx(
        TWO
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(b.{m}, 6) AS baseline, round(t.{m}, 6) AS tuned, "
            f"round(t.{m} - b.{m}, 6) AS change, round((t.{m} - b.{m}) / b.{m} * 100, 6) AS change_pct "
            "FROM eval2 b, eval2 t WHERE b.dataset = 'validation' AND t.dataset = 'validation' "
            "AND b.model = 'random_forest' AND t.model = 'boosted_trees'"
            for m in ["pr_auc", "roc_auc", "f1", "precision", "recall"]
        )
    ),
)
def e10(spark, sf):
    v = evaluated(spark, sf).filter("dataset = 'validation'")
    return rounded(
        metrics.tuning_change(v.filter("model = 'random_forest'"), v.filter("model = 'boosted_trees'"))
    )


# ---- decisions -----------------------------------------------------------------------


@query(
    "l2_decisions_all_strategies",
    tx(
        STRATEGIES
        + """SELECT transaction_id, strategy AS threshold_used, threshold AS threshold_value,
    CAST(score >= threshold AS INTEGER) AS is_fraud_predicted FROM scored, strategies"""
    ),
)
def l2(spark, sf):
    limits = scoring.strategy_thresholds(thresholds.all_strategies(curve(spark, sf)))
    scored = warehouse.scored(spark, sf).select("transaction_id", F.col("score").alias("probability"))
    return scoring.decided_by_all(scored, limits).drop("probability")


@query(
    "l3_risk_bands",
    tx("""SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
    count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM scored GROUP BY 1"""),
)
def l3(spark, sf):
    banded = warehouse.scored(spark, sf).withColumn("risk_level", scoring.risk_band(F.col("score")))
    return banded.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query(
    "l4_output_records",
    tx(
        STRATEGIES
        + """SELECT transaction_id, CAST(score >= threshold AS INTEGER) AS is_fraud_predicted, score AS probability,
    CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
    strategy AS threshold_used, threshold AS threshold_value, '1.0' AS model_version
    FROM scored, strategies WHERE strategy = 'target_performance'"""
    ),
)
def l4(spark, sf):
    limits = scoring.strategy_thresholds(thresholds.all_strategies(curve(spark, sf)))
    scored = warehouse.scored(spark, sf).withColumnRenamed("score", "probability")
    return scoring.output_records(scoring.decided(scored, limits))


@query(
    "l7_request_log_summary",
    """WITH ok AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events
      WHERE event_type <> 'error'),
    t AS (SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS good,
      date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE AS sec FROM events)
    SELECT total AS total_requests, good AS successful_requests, round(good / total::DOUBLE * 100, 2) AS success_rate,
      (SELECT round(avg(value), 6) FROM ok) AS mean_ms, (SELECT round(median(value), 6) FROM ok) AS median_ms,
      (SELECT value FROM ok WHERE i = least(n * 95 // 100, n - 1)) AS p95_ms,
      (SELECT value FROM ok WHERE i = least(n * 99 // 100, n - 1)) AS p99_ms,
      (SELECT min(value) FROM ok) AS min_ms, (SELECT max(value) FROM ok) AS max_ms,
      round(good / sec, 6) AS throughput_rps FROM t""",
)
def l7(spark, sf):
    return rounded(latency_summary(warehouse.table(spark, sf, "events")))


# ---- explanation records ---------------------------------------------------------------

PHI = """, phi AS (SELECT transaction_id, label, i AS feature_index,
    ((transaction_id * (i + 3) * 31 + i * 17) % 401 - 190 - i * 3) AS c,
    ((transaction_id * (i + 3) * 31 + i * 17) % 401 - 190 - i * 3) / 100.0::DOUBLE AS x
    FROM scored, range(30) t(i)),
  total AS (SELECT transaction_id, (sum(c) - 300) / 100.0::DOUBLE AS z FROM phi GROUP BY 1),
  names AS (SELECT unnest(range(30)) AS i, unnest([{names}]) AS feature),
  imp AS (SELECT feature_index, feature, sum(abs(c)) / (count(*) * 100.0::DOUBLE) AS mean_abs,
    sum(c) / (count(*) * 100.0::DOUBLE) AS mean_signed
    FROM phi JOIN names ON feature_index = i GROUP BY 1, 2),
  gain AS (SELECT i, feature, (i * 7 + 3) % 30 + 1 AS importance FROM names)
""".format(names=", ".join(f"'{c}'" for c in fv.MODEL_COLUMNS))


def phi(spark, sf):
    return warehouse.contributions(spark, sf)


@query(
    "x2_probability_shift",
    tx(
        PHI
        + """SELECT CAST(feature_index AS INTEGER) AS feature_index, round(avg(z), 6) AS mean_log_odds,
    round(avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - 1.0::DOUBLE / (1.0::DOUBLE + exp(-(z - x)))), 9) AS mean_shift
    FROM phi p JOIN total USING (transaction_id) GROUP BY 1"""
    ),
)
def x2(spark, sf):
    framed = importance.with_log_odds(phi(spark, sf))
    rows = framed.select("log_odds", F.posexplode("contributions").alias("feature_index", "x"))
    shift = importance.probability_shift(F.col("x"), F.col("log_odds"))
    return rows.groupBy("feature_index").agg(
        F.round(F.avg("log_odds"), 6).alias("mean_log_odds"), F.round(F.avg(shift), 9).alias("mean_shift")
    )


@query(
    "x3_top_contributors",
    tx(
        PHI
        + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(x) DESC, feature_index) AS r
      FROM phi WHERE x > 0)
    SELECT r.transaction_id, CAST(r AS INTEGER) AS rank, feature, x AS contribution_log_odds,
      round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - 1.0::DOUBLE / (1.0::DOUBLE + exp(-(z - x))), 6) AS contribution_probability
    FROM ranked r JOIN total USING (transaction_id) JOIN names ON feature_index = i WHERE r <= 3"""
    ),
)
def x3(spark, sf):
    top = importance.top_contributors(phi(spark, sf))
    # the outer form: the plain one adds a filter that computes the whole array a second time
    rows = top.select("transaction_id", F.posexplode_outer("top_contributors").alias("pos", "c"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "transaction_id",
        (F.col("pos") + 1).alias("rank"),
        "c.feature",
        "c.contribution_log_odds",
        F.round("c.contribution_probability", 6).alias("contribution_probability"),
    )


@query(
    "x4_global_importance",
    tx(
        PHI
        + """SELECT feature, CAST(feature_index AS INTEGER) AS feature_index, round(mean_abs, 6) AS mean_abs,
    round(mean_signed, 6) AS mean_signed, CAST(mean_signed > 0 AS INTEGER) AS raises_risk FROM imp"""
    ),
)
def x4(spark, sf):
    return rounded(importance.global_importance(phi(spark, sf)))


def gain_fixture(shap):
    """A second ranking of the same features, as a gain table would give."""
    return shap.select("feature", ((F.col("feature_index") * 7 + 3) % 30 + 1).cast("double").alias("importance"))


COMPARED = """, cmp AS (SELECT g.feature, g.gain_rank, s.shap_rank, g.gain_rank - s.shap_rank AS rank_diff,
      (g.gain_rank + s.shap_rank) / 2.0::DOUBLE AS avg_rank FROM
      (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS gain_rank FROM gain) g JOIN
      (SELECT *, row_number() OVER (ORDER BY round(mean_abs, 9) DESC, feature) AS shap_rank FROM imp) s
      ON g.feature = s.feature ORDER BY avg_rank, gain_rank LIMIT {n})
"""


def compared(spark, sf, top_n=20):
    shap = importance.global_importance(phi(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 9))
    return importance.compare_rankings(gain_fixture(shap), shap, top_n)


@query(
    "x6_compare_rankings",
    tx(
        PHI
        + COMPARED.format(n=20)
        + """SELECT feature, CAST(gain_rank AS INTEGER) AS gain_rank, CAST(shap_rank AS INTEGER) AS shap_rank,
    CAST(rank_diff AS INTEGER) AS rank_diff, avg_rank FROM cmp"""
    ),
)
def x6(spark, sf):
    return compared(spark, sf).select("feature", "gain_rank", "shap_rank", "rank_diff", "avg_rank")


@query(
    "x7_rank_agreement",
    tx(
        PHI
        + COMPARED.format(n=20)
        + """SELECT count(*) AS n_features, round(corr(g, s), 6) AS spearman FROM (
      SELECT rank() OVER (ORDER BY gain_rank) AS g, rank() OVER (ORDER BY shap_rank) AS s FROM cmp)"""
    ),
)
def x7(spark, sf):
    return rounded(importance.rank_agreement(compared(spark, sf)))


@query(
    "x7_major_disagreements",
    tx(
        PHI
        + COMPARED.format(n=20)
        + """SELECT feature, CAST(gain_rank AS INTEGER) AS gain_rank, CAST(shap_rank AS INTEGER) AS shap_rank
    FROM cmp WHERE abs(rank_diff) >= 5"""
    ),
)
def x7_major(spark, sf):
    return importance.major_disagreements(compared(spark, sf)).select("feature", "gain_rank", "shap_rank")


@query(
    "x8_direction",
    tx(PHI + "SELECT CAST(mean_signed > 0 AS INTEGER) AS raises_risk, count(*) AS n_features FROM imp GROUP BY 1"),
)
def x8(spark, sf):
    return importance.global_importance(phi(spark, sf)).groupBy("raises_risk").agg(F.count(F.lit(1)).alias("n_features"))


@query(
    "x9_concentration",
    tx(
        PHI
        + """, r AS (SELECT *, row_number() OVER (ORDER BY round(mean_abs, 9) DESC, feature) AS k FROM imp)
    SELECT round(sum(mean_abs) FILTER (k <= 5) / sum(mean_abs), 6) AS top5_share,
      round(sum(mean_abs) FILTER (k <= 10) / sum(mean_abs), 6) AS top10_share FROM r"""
    ),
)
def x9(spark, sf):
    shap = importance.global_importance(phi(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 9))
    return rounded(importance.concentration(shap, "mean_abs"))


@query(
    "x10_mean_total_contribution",
    tx(
        PHI
        + """SELECT round(avg(t), 6) AS mean_total_abs, count(*) AS n_rows FROM
    (SELECT sum(abs(x)) AS t FROM phi GROUP BY transaction_id)"""
    ),
)
def x10(spark, sf):
    return rounded(importance.mean_total_contribution(phi(spark, sf)))


@query(
    "x11_distribution_sample",
    tx(
        PHI
        + """, s AS (SELECT transaction_id FROM scored ORDER BY md5('1:' || transaction_id) LIMIT 1000),
    v AS (SELECT transaction_id, channel, amount, CAST(account_age_days AS DOUBLE) AS account_age_days FROM tx),
    e AS (SELECT min(amount) AS alo, max(amount) AS ahi, min(account_age_days) AS glo, max(account_age_days) AS ghi FROM v)
    SELECT s.transaction_id, feature, contribution, round(scaled_value, 6) AS scaled_value FROM s JOIN (
      SELECT v.transaction_id, 'channel' AS feature, CASE WHEN channel = 'web' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS scaled_value,
        p.x AS contribution FROM v JOIN phi p ON v.transaction_id = p.transaction_id AND p.feature_index = 0
      UNION ALL SELECT v.transaction_id, 'amount', (amount - alo) / (ahi - alo), p.x FROM v JOIN phi p
        ON v.transaction_id = p.transaction_id AND p.feature_index = 1, e
      UNION ALL SELECT v.transaction_id, 'account_age_days', (account_age_days - glo) / (ghi - glo), p.x FROM v JOIN phi p
        ON v.transaction_id = p.transaction_id AND p.feature_index = 2, e) u ON s.transaction_id = u.transaction_id"""
    ),
)
def x11(spark, sf):
    columns = ["channel", "amount", "account_age_days"]
    frame = warehouse.transactions(spark, sf).select("transaction_id", *columns).join(phi(spark, sf), "transaction_id")
    return rounded(importance.distribution_sample(frame, columns, columns))


@query(
    "x12_importance_shares",
    tx(
        PHI
        + """SELECT feature, CAST(row_number() OVER (ORDER BY round(mean_abs, 9) DESC, feature) AS INTEGER) AS rank,
    round(mean_abs / sum(mean_abs) OVER (), 6) AS share FROM imp"""
    ),
)
def x12(spark, sf):
    shap = importance.global_importance(phi(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 9))
    return rounded(importance.with_shares(shap, "mean_abs").select("feature", "rank", "share"))


@query(
    "p16_value_contribution_correlation",
    tx(
        PHI
        + """SELECT 'amount' AS feature, round(corr(amount, x), 6) AS correlation FROM tx JOIN phi
      ON tx.transaction_id = phi.transaction_id AND feature_index = 0
    UNION ALL SELECT 'account_age_days', round(corr(account_age_days, x), 6) FROM tx JOIN phi
      ON tx.transaction_id = phi.transaction_id AND feature_index = 1"""
    ),
)
def p16(spark, sf):
    columns = ["amount", "account_age_days"]
    frame = warehouse.transactions(spark, sf).select("transaction_id", *columns).join(phi(spark, sf), "transaction_id")
    return rounded(importance.value_contribution_correlation(frame, columns, columns))


# ---- the same over all model columns ---------------------------------------------------------


def with_values(spark, sf):
    """Contributions beside the engineered values of all model columns."""
    frame = warehouse.transactions(spark, sf)
    values = engineered(frame, FittedStatistics.fit(frame)).select("transaction_id", *fv.MODEL_COLUMNS)
    return values.join(phi(spark, sf), "transaction_id")


def _numeric_sql(c: str) -> str:
    return f"CASE WHEN {c} = 'web' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if c in fv.CATEGORICAL_FEATURES else f"CAST({c} AS DOUBLE)"


@query(
    "x11_distribution_sample_all",
    tx(
        featured_sql()
        + PHI
        + """, s AS (SELECT transaction_id FROM scored ORDER BY md5('1:' || transaction_id) LIMIT 1000),
    strongest AS (SELECT feature_index FROM imp ORDER BY round(mean_abs, 9) DESC, feature LIMIT 20), v AS ("""
        + " UNION ALL ".join(
            f"SELECT transaction_id, {i} AS i, '{c}' AS feature, {_numeric_sql(c)} AS v FROM featured"
            for i, c in enumerate(fv.MODEL_COLUMNS)
        )
        + """), e AS (SELECT i, min(v) AS lo, max(v) AS hi FROM v GROUP BY i)
    SELECT v.transaction_id, feature, p.x AS contribution, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS scaled_value
    FROM v JOIN e ON v.i = e.i JOIN s ON v.transaction_id = s.transaction_id JOIN strongest ON v.i = strongest.feature_index
    JOIN phi p ON v.transaction_id = p.transaction_id AND v.i = p.feature_index"""
    ),
)
def x11_all(spark, sf):
    columns = fv.MODEL_COLUMNS
    return rounded(importance.distribution_sample(with_values(spark, sf), columns, columns))


@query(
    "p16_value_contribution_correlation_all",
    tx(
        featured_sql()
        + PHI
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 THEN round(corr({c}, x), 6) END AS correlation
    FROM featured f JOIN phi ON f.transaction_id = phi.transaction_id AND feature_index = {i}"""
            for i, c in enumerate(fv.MODEL_COLUMNS)
            if c not in fv.CATEGORICAL_FEATURES
        )
    ),
)
def p16_all(spark, sf):
    numeric = [c for c in fv.MODEL_COLUMNS if c not in fv.CATEGORICAL_FEATURES]
    first = len(fv.MODEL_COLUMNS) - len(numeric)  # the categorical columns come first
    frame = with_values(spark, sf).withColumn("contributions", F.slice("contributions", first + 1, len(numeric)))
    return rounded(importance.value_contribution_correlation(frame, numeric, numeric))
