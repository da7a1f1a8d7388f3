"""Queries: encodings, training, search, model explanation, batch and stream scoring, artifacts."""

from __future__ import annotations

import functools
import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import boosted_trees, experiments, importance, learners, profiling, scoring, search
from riskweave.operators.encoders import OrdinalCodes, ScaledDummies, linear_encoding
from riskweave.operators.features import FittedStatistics, engineered
from riskweave.plans import data_queries, scoring_job, training_job
from riskweave.plans.experiment_queries import LOG
from riskweave.plans.feature_queries import featured_sql
from riskweave.plans.registry import query, rounded, tx
from riskweave.sources import artifacts, schemas, warehouse
from riskweave.sources.scratch import scratch_path, spread, staged
from riskweave.streaming import online

NUMERIC = fv.CONTINUOUS_FEATURES + fv.BINARY_FEATURES
JOBS: dict[tuple[str, str], training_job.Trained] = {}
STREAMS: dict[tuple[str, str], tuple[str, scoring_job.Deployed]] = {}

# ---- encodings ------------------------------------------------------------------------


@query(
    "m1_ordinal_codes",
    tx("""SELECT transaction_id, CASE channel WHEN 'app' THEN 0.0::DOUBLE WHEN 'web' THEN 1.0::DOUBLE END AS channel_code,
    CASE merchant_category WHEN 'electronics' THEN 0.0::DOUBLE WHEN 'fashion' THEN 1.0::DOUBLE WHEN 'gaming' THEN 2.0::DOUBLE
      WHEN 'grocery' THEN 3.0::DOUBLE ELSE -1.0::DOUBLE END AS merchant_category_code FROM tx"""),
)
def m1(spark, sf):
    frame = warehouse.transactions(spark, sf).select("transaction_id", "channel", "merchant_category")
    model = OrdinalCodes(categorical=["channel", "merchant_category"]).fit(frame.filter("merchant_category <> 'travel'"))
    return model.transform(frame).select("transaction_id", "channel_code", "merchant_category_code")


@query(
    "m2_scaled_dummies",
    tx(""", s AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(promo_used) AS mp, stddev_pop(promo_used) AS sp
      FROM tx WHERE merchant_category <> 'travel')
    SELECT transaction_id, round((amount - ma) / sa, 6) AS amount_z, round((promo_used - mp) / sp, 6) AS promo_used_z,
      CAST(channel = 'web' AS INTEGER)::DOUBLE AS channel_is_web,
      CAST(merchant_category = 'fashion' AS INTEGER)::DOUBLE AS merchant_category_is_fashion,
      CAST(merchant_category = 'gaming' AS INTEGER)::DOUBLE AS merchant_category_is_gaming,
      CAST(merchant_category = 'grocery' AS INTEGER)::DOUBLE AS merchant_category_is_grocery FROM tx, s"""),
)
def m2(spark, sf):
    frame = warehouse.transactions(spark, sf).select(
        "transaction_id", "channel", "merchant_category", "amount", "promo_used"
    )
    encoder = ScaledDummies(categorical=["channel", "merchant_category"], scaled=["amount", "promo_used"])
    out = encoder.fit(frame.filter("merchant_category <> 'travel'")).transform(frame)
    return rounded(out.select("transaction_id", *[c for c in out.columns if c.endswith("_z") or "_is_" in c]))


DUMMIES = {"channel": "web"}  # categories but the first


@query(
    "m2_scaled_dummies_all",
    tx(
        featured_sql()
        + ", s AS (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMERIC)
        + " FROM featured WHERE merchant_category <> 'travel') SELECT transaction_id, "
        + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_z" for c in NUMERIC)
        + "".join(f", CAST({c} = '{v}' AS INTEGER)::DOUBLE AS {c}_is_{v}" for c, v in DUMMIES.items())
        + " FROM featured, s"
    ),
)
def m2_all(spark, sf):
    """All model columns, as the encoder takes them by default."""
    frame = warehouse.transactions(spark, sf)
    featured = engineered(frame, FittedStatistics.fit(frame))
    out = ScaledDummies().fit(featured.filter("merchant_category <> 'travel'")).transform(featured)
    made = [f"{c}_z" for c in NUMERIC] + [f"{c}_is_{v}" for c, v in DUMMIES.items()]
    return rounded(out.select("transaction_id", *made))


def _vector_report_sql(scaled: list[str], plain: list[str]) -> str:
    parts = []
    for i, c in enumerate(scaled):
        z = f"(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END)"
        parts.append(f"SELECT {i} AS position, min(z) AS lo, max(z) AS hi FROM (SELECT {z} AS z FROM featured)")
    for i, c in enumerate(plain, len(scaled)):
        parts.append(f"SELECT {i} AS position, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM featured")
    last = len(scaled) + len(plain)
    parts.append(f"SELECT {last} AS position, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi")
    return "SELECT CAST(position AS INTEGER) AS position, round(lo, 5) AS lo, round(hi, 5) AS hi FROM (" + " UNION ALL ".join(parts) + ")"


@query(
    "m3_linear_vector_binary_passthrough",
    tx(featured_sql() + _vector_report_sql(fv.CONTINUOUS_FEATURES, fv.BINARY_FEATURES)),
)
def m3(spark, sf):
    frame = warehouse.transactions(spark, sf)
    featured = engineered(frame, FittedStatistics.fit(frame)).select(*fv.FINAL_FEATURES)
    model = linear_encoding(scale_binary=False).fit(featured)
    array = vector_to_array("features")
    width = len(fv.CONTINUOUS_FEATURES) + len(fv.BINARY_FEATURES) + 1
    values = model.transform(featured).select(array.alias("a"))
    ends = values.agg(
        *[F.min(F.get("a", F.lit(i))).alias(f"lo{i}") for i in range(width)],
        *[F.max(F.get("a", F.lit(i))).alias(f"hi{i}") for i in range(width)],
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(width)]
    )
    return rounded(ends.select(F.explode(rows).alias("r")).select("r.*"), 5)


# ---- training --------------------------------------------------------------------------


def prepared(spark, sf):
    return training_job.prepared(warehouse.transactions(spark, sf))[0]


def tuned_job(spark, sf):
    """The training job at its tuned size, run once for a session and table; many queries read its results."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in JOBS:
        JOBS[key] = training_job.train(warehouse.transactions(spark, sf))
    return JOBS[key]


def _held_out(spark, sf, family, params):
    data = prepared(spark, sf)
    model = learners.fit(data.filter("split = 'train'"), family, params)
    return training_job.evaluated(model, data.filter("split = 'validation'"), family, "validation")


@query("m4_logistic_regression")
def m4(spark, sf):
    return _held_out(spark, sf, learners.LINEAR, None)


@query("m5_random_forest")
def m5(spark, sf):
    return _held_out(spark, sf, learners.FOREST, None)


@query("m6_boosted_trees")
def m6(spark, sf):
    return _held_out(spark, sf, learners.BOOSTED, fv.TUNED_BOOSTED)


def _grid_search(spark, sf, family, grid):
    data = prepared(spark, sf).filter("split <> 'test'")
    found = search.search(data, family, search.candidates_of(grid), "grid-1")
    return experiments.candidates(found.log).select("candidate_id", "mean_test", "std_test", "mean_train", "rank")


@query("m7_grid_search")
def m7(spark, sf):
    return _grid_search(spark, sf, learners.FOREST, fv.FOREST_GRID)


@query("m7_boosted_grid_search")
def m7_boosted(spark, sf):
    return _grid_search(spark, sf, learners.BOOSTED, fv.BOOSTED_GRID)


@query("m7_tree_count_search")
def m7_counts(spark, sf):
    data = prepared(spark, sf).filter("split <> 'test'")
    params = {k: v for k, v in fv.TUNED_BOOSTED.items() if k != "n_estimators"}
    found = search.tree_count_search(data, learners.BOOSTED, params, fv.BOOSTED_TREE_COUNTS, "trees-1", refit=None)
    return experiments.iteration_curve(experiments.candidates(found.log), tuned=fv.TUNED_BOOSTED["n_estimators"])


@query("m8_logged_search")
def m8(spark, sf):
    data = prepared(spark, sf).filter("split <> 'test'")
    candidates = search.candidates_of(fv.BOOSTED_GRID, "random")
    return search.search(data, learners.BOOSTED, candidates, "random-1", refit=None).log.drop("params")  # read from the stored log


@query(
    "m10_hyperparameters_from_log",
    LOG
    + """SELECT name, value FROM (SELECT n_estimators, max_depth FROM c WHERE place = 1 AND model = 'random_forest'
      AND run_id = (SELECT max(run_id) FROM c)), (SELECT unnest(['n_estimators', 'max_depth', 'random_state']) AS name) n,
      LATERAL (SELECT CASE name WHEN 'n_estimators' THEN n_estimators WHEN 'max_depth' THEN max_depth ELSE 7 END::DOUBLE AS value)""",
)
def m10(spark, sf):
    path = scratch_path(spark, "candidate-log")
    artifacts.save_candidate_log(warehouse.candidate_log(spark, sf), path)
    found = artifacts.load_hyperparameters(spark, "random_forest", log=path, seed=7)
    return artifacts.summary_rows(spark, found)


BEST_OF_LOG = (
    LOG
    + """SELECT name, value FROM (SELECT n_estimators, max_depth FROM c WHERE place = 1 AND model = 'random_forest'
      AND run_id = (SELECT max(run_id) FROM c)), (SELECT unnest(['n_estimators', 'max_depth']) AS name) n,
      LATERAL (SELECT CASE name WHEN 'n_estimators' THEN n_estimators ELSE max_depth END::DOUBLE AS value)"""
)


def _best_of_log(spark, sf):
    path = scratch_path(spark, "candidate-log")
    artifacts.save_candidate_log(warehouse.candidate_log(spark, sf), path)
    return artifacts.load_hyperparameters(spark, "random_forest", log=path)


@query("m10_hyperparameters_from_run_record", BEST_OF_LOG)
def m10_run(spark, sf):
    """Parameters of the newest run of the family; older runs and other families are not taken."""
    path, best = scratch_path(spark, "runs"), _best_of_log(spark, sf)
    scores = {m: 0.0 for m in fv.METRICS}
    for run, family, params in (("a", "random_forest", {"n_estimators": 1}), ("b", "random_forest", best), ("c", "boosted_trees", {"n_estimators": 2})):
        artifacts.append_training_run(artifacts.training_run(spark, run, family, params, {}, {}, 1.0, scores), path)
    return artifacts.summary_rows(spark, artifacts.load_hyperparameters(spark, "rf", runs=path))


@query("m10_hyperparameters_from_file", BEST_OF_LOG)
def m10_file(spark, sf):
    """Parameters from a stored JSON document."""
    path, best = scratch_path(spark, "params"), _best_of_log(spark, sf)
    document = json.dumps({"hyperparameters": {f"classifier__{k}": str(v) for k, v in best.items()}})
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    return artifacts.summary_rows(spark, artifacts.load_hyperparameters(spark, "rf", file=path))


@query("m11_training_job")
def m11(spark, sf):
    return tuned_job(spark, sf).strategies


@query("m12_iteration_tracking")
def m12(spark, sf):
    data = prepared(spark, sf).filter("split <> 'test'")
    return search.iteration_tracking(data, fv.TUNED_BOOSTED)


@query("m12_degradation")
def m12_degradation(spark, sf):
    data = prepared(spark, sf).filter("split <> 'test'")
    tracking = staged(search.iteration_tracking(data, fv.TUNED_BOOSTED), "tracking")
    return search.degradation(tracking, tuned=fv.TUNED_BOOSTED["n_estimators"])


LOGS: dict[tuple[str, str], DataFrame] = {}
FAMILIES = {
    learners.LINEAR: [learners.BASELINE[learners.LINEAR]],
    learners.FOREST: [learners.BASELINE[learners.FOREST]],
    learners.BOOSTED: [fv.TUNED_BOOSTED],
}


def _families_log(spark, sf):
    """Three families on the same four folds, fitted once for a session and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in LOGS:
        LOGS[key] = search.cross_validate(prepared(spark, sf).filter("split <> 'test'"), FAMILIES, "families-1")
    return LOGS[key]


@query("m13_family_gaps")
def m13_families(spark, sf):
    return experiments.gap_diagnosis(experiments.fold_gaps(_families_log(spark, sf)))


@query(
    "m13_family_gap_facts",
    tx(
        data_queries.RANKED
        + """SELECT model, CAST(count(DISTINCT fold) AS BIGINT) AS n_folds, CAST(count(DISTINCT fold) AS BIGINT) AS n_gaps, 1 AS is_mean,
      1 AS is_judged FROM (SELECT unnest(range(4)) AS fold, is_fraud FROM parts WHERE split <> 'test'),
      (SELECT unnest(['boosted_trees', 'logistic_regression', 'random_forest']) AS model) GROUP BY model"""
    ),
)
def m13_facts(spark, sf):
    """Folds of each family, folds whose gap is train less validation, and whether the summary and its verdict follow from them."""
    log = _families_log(spark, sf)
    value = lambda s: F.max(F.when(F.col("split") == s, F.col("value")))
    each = log.filter("metric = 'pr_auc'").groupBy("model", "fold").agg(value("train").alias("a"), value("test").alias("b"))
    each = each.join(experiments.fold_gaps(log).select("model", "fold", "gap"), ["model", "fold"])
    gap = F.col("a") - F.col("b")
    mean = each.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(F.abs(gap - F.col("gap")) < 1e-12).alias("n_gaps"), F.avg(gap).alias("m"))
    told = experiments.gap_diagnosis(experiments.fold_gaps(log)).select("model", "mean_gap", "train_mean", "val_mean", "diagnosis")
    verdict = (
        F.when(F.col("mean_gap") > 0.15, "high variance, severe")
        .when(F.col("mean_gap") > 0.10, "high variance, moderate")
        .when((F.col("train_mean") < 0.3) & (F.col("val_mean") < 0.3), "high bias")
        .otherwise("good fit")
    )
    return mean.join(told, "model").select(
        "model", "n_folds", "n_gaps", (F.abs(F.col("m") - F.col("mean_gap")) < 1e-9).cast("int").alias("is_mean"),
        (F.col("diagnosis") == verdict).cast("int").alias("is_judged"),
    )


# ---- explanation of a fitted model ----------------------------------------------------------


def fitted_boosted(spark, sf):
    """The tuned model of the training job, and the test rows."""
    job = tuned_job(spark, sf)  # the model's first stage makes the features that the job's rows already have
    return PipelineModel(job.model.stages[1:]), job.data.filter("split = 'test'")


@query(
    "x1_contributions_additive",
    tx(data_queries.RANKED + "SELECT count(*) AS n_rows, count(*) AS n_additive FROM parts WHERE split = 'test'"),
)
def x1(spark, sf):
    """Rows whose bias and contributions add up to the model's own log-odds."""
    model, test = fitted_boosted(spark, sf)
    scored = learners.predicted(model, test)
    explained = boosted_trees.contributions(model, scored, "transaction_id", "probability_fraud")
    p = F.col("probability_fraud")
    gap = F.abs(F.log(p / (F.lit(1.0) - p)) - F.col("log_odds"))
    return explained.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gap < 1e-9).alias("n_additive"))


@query("x1_model_importance")
def x1_importance(spark, sf):
    model, test = fitted_boosted(spark, sf)
    return importance.global_importance(boosted_trees.contributions(model, test, "transaction_id"))


@query("x5_gain_importance")
def x5(spark, sf):
    return boosted_trees.gain_importance(fitted_boosted(spark, sf)[0])


@query("x6_model_rankings")
def x6_model(spark, sf):
    model, test = fitted_boosted(spark, sf)
    shap = importance.global_importance(boosted_trees.contributions(model, test, "transaction_id"))
    return importance.compare_rankings(boosted_trees.gain_importance(model), shap)


@query("p15_amount_bands_with_contribution")
def p15_contribution(spark, sf):
    model, test = fitted_boosted(spark, sf)
    rows = boosted_trees.contributions(model, test, "transaction_id", "amount", "is_fraud")
    place = fv.MODEL_COLUMNS.index("amount")
    return profiling.binned_rates(
        rows.withColumn("contribution", F.get("contributions", F.lit(place))), measure="contribution"
    )


@query("p16_model_value_correlation")
def p16_model(spark, sf):
    model, test = fitted_boosted(spark, sf)
    numeric = [c for c in fv.MODEL_COLUMNS if c not in fv.CATEGORICAL_FEATURES]
    rows = boosted_trees.contributions(model, test, "transaction_id", *numeric)
    found = rows.withColumn("contributions", F.slice("contributions", 2, len(numeric)))
    return importance.value_contribution_correlation(found, numeric, numeric)


# ---- scoring -----------------------------------------------------------------------------------


def deployed(spark, sf):
    folder = scratch_path(spark, "deployed")
    training_job.save_all(spark, tuned_job(spark, sf), folder, "run-1")
    return scoring_job.Deployed.load(spark, folder)


@query("l1_score_batch")
def l1(spark, sf):
    ready = deployed(spark, sf)
    accepted, _ = scoring_job.score_batch(data_queries.broken_requests(spark, sf), ready)
    return accepted


@query(
    "l1_score_batch_consistency",
    tx("""SELECT count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_accepted,
    count(*) FILTER (transaction_id % 50 BETWEEN 1 AND 6) AS n_rejected,
    count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_decided,
    count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_banded,
    count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_explained FROM tx"""),
)
def l1_consistency(spark, sf):
    """Rows accepted and rejected, and accepted rows whose decision, band and explanation fit their probability."""
    requests = data_queries.broken_requests(spark, sf)
    accepted, rejected = scoring_job.score_batch(requests, deployed(spark, sf), include_explanation=True)
    p = F.col("probability")
    band = F.when(p >= 0.7, "high").when(p >= 0.3, "medium").otherwise("low")
    explained = F.abs(F.col("explanation.final_fraud_probability") - p) < 1e-9
    return accepted.agg(
        F.count(F.lit(1)).alias("n_accepted"),
        F.count_if(F.col("is_fraud_predicted") == (p >= F.col("threshold_value")).cast("int")).alias("n_decided"),
        F.count_if(F.col("risk_level") == band).alias("n_banded"),
        F.count_if(explained).alias("n_explained"),
    ).withColumn("n_rejected", rejected.agg(F.count(F.lit(1))).scalar())


@query("l5_score_batch_explained")
def l5(spark, sf):
    ready = deployed(spark, sf)
    accepted, _ = scoring_job.score_batch(
        data_queries.broken_requests(spark, sf), ready, "balanced_85pct_recall", include_explanation=True
    )
    return accepted.select(
        *scoring.OUTPUT,
        F.col("explanation.base_fraud_rate").alias("base_fraud_rate"),
        F.col("explanation.final_fraud_probability").alias("final_fraud_probability"),
        F.get("explanation.top_contributors", F.lit(0))["feature"].alias("first_feature"),
        F.get("explanation.top_contributors", F.lit(0))["contribution_probability"].alias("first_shift"),
    )


def _run_stream(spark, sf):
    """Requests as JSON files through the stream, scored by the stored model; run once for a session and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in STREAMS:
        ready, root = deployed(spark, sf), scratch_path(spark, "stream")
        spread(data_queries.broken_requests(spark, sf)).write.json(f"{root}/in")
        online.start_scoring(
            online.request_stream(spark, f"{root}/in", schemas.request_schema(), files_per_batch=online.files_at_once(spark)),
            ready.stats,
            ready.score,
            ready.thresholds,
            f"{root}/accepted",
            f"{root}/rejected",
            f"{root}/checkpoint",
            extra=("hour_local", "is_large_transaction", "country_mismatch"),
        ).awaitTermination()
        STREAMS[key] = root, ready
    return STREAMS[key]


@query(
    "l6_stream_accepted",
    tx(
        data_queries.RANKED
        + ", train AS (SELECT tx.* FROM tx JOIN parts ON tx.transaction_id = parts.transaction_id WHERE split = 'train')"
        + featured_sql("train")
        + """SELECT transaction_id, 1 AS is_decided, 1 AS is_banded, 'target_performance' AS threshold_used, '1.0' AS model_version,
      CASE WHEN transaction_id % 50 <> 7 THEN hour_local ELSE -1 END AS hour_local, is_large_transaction, country_mismatch
    FROM featured WHERE transaction_id % 50 NOT BETWEEN 1 AND 6"""
    ),
)
def l6(spark, sf):
    """Streamed rows that the stored model scored: whether decision and band fit the probability, and features."""
    accepted, p = spark.read.parquet(f"{_run_stream(spark, sf)[0]}/accepted"), F.col("probability")
    band = F.when(p >= 0.7, "high").when(p >= 0.3, "medium").otherwise("low")
    return accepted.select(
        "transaction_id",
        (F.col("is_fraud_predicted") == (p >= F.col("threshold_value")).cast("int")).cast("int").alias("is_decided"),
        (F.col("risk_level") == band).cast("int").alias("is_banded"),
        "threshold_used",
        "model_version",
        F.coalesce("hour_local", F.lit(-1)).alias("hour_local"),
        "is_large_transaction",
        "country_mismatch",
    )


@query(
    "l6_stream_equals_batch",
    tx("""SELECT count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_accepted,
    count(*) FILTER (transaction_id % 50 NOT BETWEEN 1 AND 6) AS n_accepted_equal,
    count(*) FILTER (transaction_id % 50 BETWEEN 1 AND 6) AS n_rejected,
    count(*) FILTER (transaction_id % 50 BETWEEN 1 AND 6) AS n_rejected_equal FROM tx"""),
)
def l6_equal(spark, sf):
    """Rows that the stream and the batch job score or reject alike, with the same stored model."""
    root, ready = _run_stream(spark, sf)
    accepted, rejected = scoring_job.score_batch(data_queries.broken_requests(spark, sf), ready)
    streamed = spark.read.parquet(f"{root}/accepted").select(*[F.col(c).alias(f"s_{c}") for c in scoring.OUTPUT])
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in scoring.OUTPUT if c != "probability"]
    alike = functools.reduce(Column.__and__, same, F.abs(F.col("probability") - F.col("s_probability")) < 1e-12)
    both = accepted.join(streamed, F.col("transaction_id") == F.col("s_transaction_id"), "full")
    bad = spark.read.parquet(f"{root}/rejected").select(F.col("transaction_id").alias("s_transaction_id"), F.col("errors").alias("s_errors"))
    refused = rejected.join(bad, F.col("transaction_id") == F.col("s_transaction_id"), "full")
    return both.agg(F.count(F.lit(1)).alias("n_accepted"), F.count_if(alike).alias("n_accepted_equal")).crossJoin(
        refused.agg(F.count(F.lit(1)).alias("n_rejected"), F.count_if(F.col("errors") == F.col("s_errors")).alias("n_rejected_equal"))
    )  # one row beside one row


@query(
    "l6_stream_rejected",
    tx("""SELECT CASE transaction_id % 50 WHEN 1 THEN 'amount:negative' WHEN 2 THEN 'country:not_two_letters'
      WHEN 3 THEN 'channel:unknown' WHEN 4 THEN 'transaction_time:format' WHEN 5 THEN 'promo_used:not_flag'
      ELSE 'merchant_category:required' END AS error, count(*) AS n FROM tx
    WHERE transaction_id % 50 BETWEEN 1 AND 6 GROUP BY 1"""),
)
def l6_rejected(spark, sf):
    rejected = spark.read.parquet(f"{_run_stream(spark, sf)[0]}/rejected")
    return rejected.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# ---- artifacts -----------------------------------------------------------------------------------


@query(
    "sc3_newest_logs",
    LOG
    + """SELECT model, model || '_cv_results_20250202.csv' AS source_name, count(*) AS n_candidates,
    round(max(mean_test), 6) AS best_score FROM c WHERE CAST(run_id AS INTEGER) % 2 = 1 GROUP BY model""",
)
def sc3(spark, sf):
    root = scratch_path(spark, "cv-logs")
    wide = staged(experiments.wide_from_long(warehouse.candidate_log(spark, sf), ["pr_auc"], 4).drop("params"), "wide")
    for model in ("random_forest", "boosted_trees"):
        for stamp, odd in (("20250101", 0), ("20250202", 1)):
            rows = wide.filter((F.col("model") == model) & (F.col("run_id").cast("int") % 2 == odd)).drop("model")
            rows.write.option("header", True).csv(f"{root}/{model}_cv_results_{stamp}.csv")
    patterns = {m: f"{root}/{m}_cv_results_*.csv" for m in ("random_forest", "boosted_trees")}
    schema = wide.drop("model").schema
    logs = artifacts.newest_wide_logs(spark, patterns, schema)
    table = logs.groupBy("model", "source_name").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("mean_test_pr_auc").alias("best_score")
    )
    return rounded(table)


@query(
    "sc6_training_run_record",
    tx(
        data_queries.RANKED
        + """SELECT 'boosted_trees' AS model, count(*) FILTER (split = 'train') AS n_train,
      count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split <> 'test') AS n_train_validation,
      count(*) FILTER (split = 'test') AS n_test, round(avg(is_fraud) FILTER (split <> 'test'), 6) AS rate_train_validation,
      round(avg(is_fraud) FILTER (split = 'test'), 6) AS rate_test,
      round(count(*) FILTER (split <> 'test' AND is_fraud = 0) / count(*) FILTER (split <> 'test' AND is_fraud = 1)::DOUBLE, 6)
        AS class_imbalance_ratio, 30 AS n_features, 6 AS n_metrics FROM parts"""
    ),
)
def sc6(spark, sf):
    folder = scratch_path(spark, "run-record")
    training_job.save_all(spark, tuned_job(spark, sf), folder, "run-1")
    runs = artifacts.load_training_runs(spark, f"{folder}/training_runs")
    return rounded(
        runs.select(
            "model",
            F.col("samples")["train"].alias("n_train"),
            F.col("samples")["validation"].alias("n_validation"),
            F.col("samples")["train_validation"].alias("n_train_validation"),
            F.col("samples")["test"].alias("n_test"),
            F.col("positive_rates")["train_validation"].alias("rate_train_validation"),
            F.col("positive_rates")["test"].alias("rate_test"),
            "class_imbalance_ratio",
            "n_features",
            F.size("test_metrics").alias("n_metrics"),
        )
    )


@query(
    "sc7_model_save_load",
    tx(data_queries.RANKED + "SELECT count(*) AS n_rows, count(*) AS n_equal FROM parts WHERE split = 'test'"),
)
def sc7(spark, sf):
    """Rows that a stored and reloaded pipeline (features and classifier together) scores as before."""
    trained = training_job.train(warehouse.transactions(spark, sf), learners.LINEAR)
    path = scratch_path(spark, "model")
    learners.save_model(trained.model, path)
    again = learners.load_model(path).transform(trained.raw.filter("split = 'test'"))
    both = again.select("transaction_id", vector_to_array("probability")[1].alias("p")).join(
        trained.scored_test, "transaction_id"
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("p") - F.col("score")) < 1e-12).alias("n_equal")
    )


@query(
    "sc8_all_diagnostics",
    LOG
    + """, d AS (SELECT run_id, 'fold_details' AS name, (tr - te) / 10000.0::DOUBLE AS x FROM f
      UNION ALL SELECT run_id, 'gap_summary', mean_gap FROM c UNION ALL SELECT run_id, 'iteration_tracking', mean_test FROM c
      UNION ALL SELECT run_id, 'variance', std_test / mean_test * 100 FROM c WHERE place = 1
      UNION ALL SELECT run_id, 'cv_results', mean_train FROM c)
    SELECT name, run_id, count(*) AS n, round(sum(x), 6) AS total FROM d GROUP BY ALL""",
)
def sc8_all(spark, sf):
    """Five stored diagnostics, each run written twice, then read."""
    path, log = scratch_path(spark, "all-diagnostics"), staged(warehouse.candidate_log(spark, sf), "log")
    artifacts.save_run_diagnostics(log, path)
    artifacts.save_run_diagnostics(log.filter(F.col("run_id").cast("int") % 2 == 0), path)  # some runs are replayed
    measure = {"fold_details": "gap", "gap_summary": "mean_gap", "iteration_tracking": "val_score_mean", "variance": "cv_coef_pct", "cv_results": "mean_train_pr_auc"}
    parts = [
        artifacts.load_diagnostic(spark, path, name, f"{x} double, run_id string")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"))
        .select(F.lit(name).alias("name"), "run_id", "n", "total")
        for name, x in measure.items()
    ]
    return rounded(functools.reduce(lambda a, b: a.unionByName(b), parts))


@query(
    "sc8_diagnostics_by_run",
    LOG
    + """SELECT run_id, model, round(std_test / mean_test * 100, 6) AS cv_coef_pct FROM c
    WHERE place = 1""",
)
def sc8(spark, sf):
    path = scratch_path(spark, "diagnostics")
    table = experiments.candidates(warehouse.candidate_log(spark, sf))
    artifacts.save_diagnostics(experiments.fold_variation(table), path)
    schema = "run_id string, model string, mean_score double, std_score double, cv_coef_pct double, variation string"
    stored = artifacts.load_newest(spark, path, schema)
    return rounded(stored.select("run_id", "model", "cv_coef_pct"))
