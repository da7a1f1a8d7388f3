"""Sources, validation, profiling and experiment analytics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import experiments as ex
from riskweave.operators import metrics, profiling, validation
from riskweave.operators.request_log import latency_summary
from riskweave.sources import artifacts, files, scratch
from riskweave.sources.schemas import CANDIDATE_LOG, TRANSACTION


def request(spark, **changes):
    row = {
        "user_id": 1,
        "account_age_days": 10,
        "total_transactions_user": 3,
        "avg_amount_user": 5.0,
        "amount": 7.0,
        "country": "us",
        "bin_country": "US",
        "channel": "web",
        "merchant_category": "retail",
        "promo_used": 0,
        "avs_match": 1,
        "cvv_result": 1,
        "three_ds_flag": 1,
        "shipping_distance_km": 1.0,
        "transaction_time": "2024-01-15 14:30:00",
        **changes,
    }
    schema = (
        "user_id long, account_age_days int, total_transactions_user int, avg_amount_user double, amount double,"
        "country string, bin_country string, channel string, merchant_category string, promo_used int, avs_match int,"
        "cvv_result int, three_ds_flag int, shipping_distance_km double, transaction_time string"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    ("changes", "errors"),
    [
        ({}, []),
        ({"amount": -1.0}, ["amount:negative"]),
        ({"amount": None}, ["amount:required"]),
        ({"country": "USA"}, ["country:not_two_letters"]),
        ({"bin_country": "U"}, ["bin_country:not_two_letters"]),
        ({"channel": "mobile"}, ["channel:unknown"]),
        ({"channel": "WEB"}, ["channel:unknown"]),
        ({"promo_used": 2}, ["promo_used:not_flag"]),
        ({"transaction_time": "2024-01-15T14:30:00"}, ["transaction_time:format"]),
        ({"transaction_time": "15/01/2024"}, ["transaction_time:format"]),
        ({"account_age_days": -1, "three_ds_flag": -1}, ["account_age_days:negative", "three_ds_flag:not_flag"]),
        ({"user_id": -5}, ["user_id:negative"]),
    ],
)
def test_request_rules(spark, changes, errors):
    assert validation.checked(request(spark, **changes)).first()["errors"] == errors


def test_bad_time_becomes_null(spark):
    frame = spark.createDataFrame([("2024-01-15 10:00:00",), ("nope",), ("2024-13-01 00:00:00",), (None,)], "transaction_time string")
    out = validation.with_utc_time(frame)
    assert out.schema["transaction_time"].dataType.simpleString() == "timestamp_ntz"
    assert [r[0] is None for r in out.collect()] == [False, True, True, True]


def test_countries_are_upper_cased(spark):
    assert validation.with_upper_countries(request(spark)).first()["country"] == "US"


def test_grain_check_sees_duplicates(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "transaction_id long, user_id long")
    row = validation.grain_check(frame).first()
    assert (row["n_rows"], row["n_keys"], row["is_unique"]) == (3, 2, 0)


def test_csv_round_trip_and_missing_path(spark, transactions, tmp_path):
    frame = transactions.select(*TRANSACTION.fieldNames())
    files.write_csv(frame, str(tmp_path / "t"))
    again = files.read_transactions_csv(spark, str(tmp_path / "t"))
    assert again.exceptAll(frame).isEmpty() and frame.exceptAll(again).isEmpty()
    with pytest.raises(FileNotFoundError):
        files.read_transactions_csv(spark, str(tmp_path / "none"))


def test_staged_table_keeps_rows_and_schema(spark, transactions):
    stored = scratch.staged(transactions, "t")
    assert stored.dtypes == transactions.dtypes
    assert stored.count() == transactions.count()


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getConf(self):
        return self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf, self.configured = _Context(master), self, configured

    def get(self, key, default=None):
        return self.configured or default


def test_scratch_folder_comes_from_the_session():
    assert scratch.scratch_root(_Session("yarn", "/shared/cp/")) == "/shared/cp"
    assert scratch.scratch_root(_Session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(_Session("yarn"))


def test_mutual_information_by_hand(spark):
    rows = [("a", 1)] * 3 + [("a", 0)] * 1 + [("b", 0)] * 4
    frame = spark.createDataFrame(rows, "c string, is_fraud int")
    want = 3 / 8 * math.log((3 / 8) / (4 / 8 * 3 / 8)) + 1 / 8 * math.log((1 / 8) / (4 / 8 * 5 / 8)) + 4 / 8 * math.log((4 / 8) / (4 / 8 * 5 / 8))
    assert profiling.mutual_information(frame, ["c"]).first()["mi_score"] == pytest.approx(want)


def test_independent_column_has_no_information(spark):
    frame = spark.range(8).select((F.col("id") % 2).alias("c"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("is_fraud"))
    assert profiling.mutual_information(frame, ["c"]).first()["mi_score"] == pytest.approx(0.0, abs=1e-12)


def test_correlations_sorted_and_constant_is_null(spark):
    rows = [(float(i), float(-i * i), 1.0, int(i > 5)) for i in range(10)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, is_fraud int")
    got = [(r["feature"], r["correlation"]) for r in profiling.label_correlations(frame, ["a", "b", "c"]).collect()]
    assert [f for f, _ in got][-1] == "c" and got[-1][1] is None
    for f, r in got[:2]:
        assert r == pytest.approx(np.corrcoef([x["abc".index(f)] for x in rows], [x[3] for x in rows])[0, 1])


def test_inflation_matches_regressions(transactions):
    columns = ["account_age_days", "total_transactions_user", "avg_amount_user", "amount", "shipping_distance_km"]
    got = {r["feature"]: r["vif"] for r in profiling.inflation_factors(transactions, columns).collect()}
    x = np.array(transactions.select(*columns).collect(), dtype=float)
    for i, c in enumerate(columns):
        others = np.delete(x, i, axis=1)
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / (x[:, i] ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_collinear_columns_have_no_inflation_factor(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    bands = profiling.inflation_bands(profiling.inflation_factors(frame, ["a", "b"])).collect()
    assert {r["band"] for r in bands} == {"undefined"}


def test_histogram_of_constant_and_maximum(spark):
    frame = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (5.0, 4.0)], "a double, b double")
    got = {(r["feature"], r["bin"]): r["n"] for r in profiling.histogram(frame, ["a", "b"], 5).collect()}
    assert got == {("a", 2): 3, ("b", 0): 1, ("b", 4): 1, ("b", 2): 1}


def test_imbalance(spark):
    one = spark.createDataFrame([(0,)] * 3, "is_fraud int")
    assert profiling.class_distribution(one).first()["imbalance_ratio"] == 1.0
    many = spark.createDataFrame([(0,)] * 44 + [(1,)], "is_fraud int")
    row = profiling.class_distribution(many).first()
    assert row["imbalance_ratio"] == pytest.approx(44.0) and row["is_imbalanced"] == 1


def test_latency_summary(spark):
    rows = [(float(i), "ok", i) for i in range(1, 101)] + [(1e6, "error", 101)]
    frame = spark.createDataFrame(rows, "value double, event_type string, s int").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, s)")
    )
    row = latency_summary(frame).first()
    assert (row["p95_ms"], row["p99_ms"], row["median_ms"], row["max_ms"]) == (96.0, 100.0, 50.5, 100.0)
    assert row["success_rate"] == pytest.approx(99.01)
    assert row["throughput_rps"] == pytest.approx(1.0)


def test_latency_of_failures_only(spark):
    frame = spark.sql("SELECT 1.0D AS value, 'error' AS event_type, timestamp_ntz'2024-01-01 00:00:00' AS ts")
    row = latency_summary(frame).first()
    assert row["successful_requests"] == 0 and row["p95_ms"] is None and row["throughput_rps"] is None


# ---- model comparison ---------------------------------------------------------------


def test_compare_and_best(spark):
    frame = spark.createDataFrame(
        [("lr", "v", 0.70, 0.9), ("rf", "v", 0.8, 0.95), ("gbt", "v", 0.8, 0.99)], "model string, dataset string, pr_auc double, roc_auc double"
    )
    table = metrics.compare_models(frame, ["roc_auc", "pr_auc", "missing"])
    assert table.columns == ["model", "roc_auc", "pr_auc"]
    assert metrics.best_model(table, "roc_auc").first()["model"] == "gbt"
    assert {r["metric"]: r["model"] for r in metrics.best_per_metric(table).collect()} == {"pr_auc": "gbt", "roc_auc": "gbt"}
    with pytest.raises(ValueError, match="brier"):
        metrics.best_model(table, "brier")


# ---- experiment logs ------------------------------------------------------------------


def log_of(spark, scores, model="random_forest", train_extra=0.0):
    """One candidate per entry: validation scores of its folds."""
    rows = []
    for c, folds in enumerate(scores):
        params = {"param_classifier__n_estimators": str(10 * (c + 1))}
        for f, v in enumerate(folds):
            rows.append(("r", model, c, params, f, "test", "pr_auc", v))
            rows.append(("r", model, c, params, f, "train", "pr_auc", v + train_extra))
            rows.append(("r", model, c, params, f, "time", "score_time", 0.1 * (c + 1)))
            rows.append(("r", model, c, params, f, "time", "fit_time", 1.0))
    return spark.createDataFrame(rows, CANDIDATE_LOG)


def test_candidate_ranks_and_ties(spark):
    table = ex.candidates(log_of(spark, [[0.8, 0.9], [0.85, 0.85], [0.7, 0.7]]))
    rows = {r["candidate_id"]: r for r in table.collect()}
    assert [rows[i]["rank"] for i in range(3)] == [1, 1, 3]
    assert rows[0]["std_test"] == pytest.approx(0.05)
    assert ex.best_candidates(table).first()["candidate_id"] == 0
    assert {(r["name"], r["value"]) for r in ex.best_parameters(table).collect()} == {("n_estimators", "10")}


@pytest.mark.parametrize(
    ("extra", "diagnosis"), [(0.0, "good"), (0.05, "moderate"), (0.2, "severe")]
)
def test_gap_bands(spark, extra, diagnosis):
    row = ex.best_gap(ex.candidates(log_of(spark, [[0.8, 0.8]], train_extra=extra))).first()
    assert row["diagnosis"] == diagnosis
    assert row["overfitting_detected"] == int(diagnosis != "good")
    assert row["gap_pct"] == pytest.approx(extra / (0.8 + extra))


def test_gap_needs_train_scores(spark):
    wide = spark.createDataFrame([(0.9, 0.01, 1)], "mean_test_score double, std_test_score double, rank_test_score int")
    with pytest.raises(ValueError, match="training scores"):
        ex.best_gap(ex.candidates_from_wide(wide))


def test_single_metric_log_falls_back(spark):
    wide = spark.createDataFrame(
        [(0.85, 0.01, 2, 1.0), (0.95, 0.02, 1, 10.0)],
        "mean_test_score double, std_test_score double, rank_test_score int, param_C double",
    )
    table = ex.candidates_from_wide(wide, "pr_auc")
    best = ex.best_candidates(table).first()
    assert best["mean_test"] == 0.95 and best["params"] == {"C": "10.0"}
    with pytest.raises(ValueError, match="mean_test_score"):
        ex.candidates_from_wide(wide.drop("mean_test_score"))


def test_iteration_optimum_is_lowest_on_ties(spark):
    curve = ex.iteration_curve(ex.candidates(log_of(spark, [[0.7], [0.9], [0.9]]).withColumn("params", F.create_map(F.lit("n_estimators"), F.element_at("params", "param_classifier__n_estimators")))), tuned=30)
    rows = {r["n_estimators"]: r for r in curve.collect()}
    assert [rows[n]["is_optimum"] for n in (10, 20, 30)] == [0, 1, 0]
    assert rows[30]["is_tuned"] == 1
    suggestion = ex.suggested_range(curve).first()
    assert (suggestion["low"], suggestion["middle"], suggestion["high"]) == (10, 20, 40)


def test_fold_variation_bands(spark):
    rows = ex.fold_variation(ex.candidates(log_of(spark, [[0.9, 0.7]]))).first()
    assert rows["variation"] == "high" and rows["cv_coef_pct"] == pytest.approx(12.5)


def test_verdict(spark):
    forest = log_of(spark, [[0.9, 0.9]], "random_forest", 0.1)
    boosted = log_of(spark, [[0.85, 0.85]], "boosted_trees", 0.0)
    row = ex.run_verdict(ex.best_gap(ex.candidates(forest.unionByName(boosted)))).first()
    assert row["better_model"] == "random_forest"
    assert row["verdict"] == "prefer boosted_trees, the other overfits"


def test_typed_parameters_and_sources(spark, tmp_path):
    assert artifacts.typed_params({"param_classifier__max_depth": "4.0", "learning_rate": "0.1", "criterion": "gini"}) == {
        "max_depth": 4,
        "learning_rate": 0.1,
        "criterion": "gini",
    }
    (tmp_path / "p.json").write_text('{"hyperparameters": {"n_estimators": 90, "gamma": 0}}')
    got = artifacts.load_hyperparameters(spark, "xgboost", file=str(tmp_path / "p.json"), seed=3)
    assert got == {"n_estimators": 90, "gamma": 0.0, "random_state": 3}
    with pytest.raises(FileNotFoundError):
        artifacts.load_hyperparameters(spark, "xgboost")
    with pytest.raises(ValueError):
        artifacts.load_hyperparameters(spark, "svm")
    assert artifacts.load_hyperparameters(spark, "rf", fallback=True)["n_estimators"] == 100


def test_candidate_log_store_replaces_only_its_run(spark, tmp_path):
    path = str(tmp_path / "log")
    log = log_of(spark, [[0.8, 0.9]])
    artifacts.save_candidate_log(log, path)
    artifacts.save_candidate_log(log.withColumn("run_id", F.lit("s")), path)
    artifacts.save_candidate_log(log.withColumn("value", F.lit(0.5)), path)
    assert artifacts.load_candidate_log(spark, path).count() == 2 * log.count()
    assert {r["value"] for r in artifacts.load_candidate_log(spark, path, "r").select("value").collect()} == {0.5}


def test_newest_log_by_name(spark, tmp_path):
    for name in ("rf_cv_results_1", "rf_cv_results_2", "gbt_cv_results_1"):
        spark.range(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    found = artifacts.newest_paths(
        spark, {"rf": f"{tmp_path}/rf_cv_results_*.csv", "gbt": f"{tmp_path}/gbt_cv_results_*.csv", "lr": f"{tmp_path}/lr_*.csv"}
    )
    assert {m: p.rsplit("/", 1)[-1] for m, p in found.items()} == {"rf": "rf_cv_results_2.csv", "gbt": "gbt_cv_results_1.csv"}


def test_stored_runs_take_one_folder_a_write_and_null_runs_are_replaced(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(300).selectExpr("nullif(cast(id % 100 as string), '7') AS run_id", "cast(id AS double) AS x")
    artifacts.save_diagnostics(rows, path)
    artifacts.save_diagnostics(rows.filter("run_id IS NULL OR run_id = '8'").withColumn("x", F.lit(-1.0)), path)
    assert len(list((tmp_path / "runs").iterdir())) == 2  # a folder a run before: 101
    found = artifacts.load_newest(spark, path, "run_id string, x double")
    counts = {r["run_id"]: (r["n"], r["low"]) for r in found.groupBy("run_id").agg(F.count("x").alias("n"), F.min("x").alias("low")).collect()}
    assert len(counts) == 100 and counts[None] == counts["8"] == (3, -1.0) and counts["9"] == (3, 9.0)


def test_candidates_are_hashed_and_keep_their_parameters(spark):
    log = log_of(spark, [[0.8, 0.9], [0.7, 0.6]])
    partial = log.withColumn("params", F.when(F.col("fold") == 1, F.col("params"))).withColumn("run_id", F.lit(None).cast("string"))
    want = {r["candidate_id"]: r["params"] for r in ex.candidates(log).collect()}
    got = {r["candidate_id"]: r["params"] for r in ex.candidates(partial).collect()}
    assert got == want and len(got) == 2
    none = ex.candidates(log.withColumn("params", F.lit(None).cast("map<string,string>"))).collect()
    assert [r["params"] for r in none] == [None, None]
    plan = ex.candidates(log, params=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
