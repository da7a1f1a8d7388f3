"""Encoders, learners, explanations, search, scoring and the stream."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import fixed_values as fv
from riskweave.operators import boosted_trees as bt
from riskweave.operators import encoders, experiments, importance, learners, metrics, scoring, search, tree_models
from riskweave.plans import data_queries, model_queries, scoring_job, training_job
from riskweave.sources import artifacts, schemas, warehouse
from riskweave.streaming import online

PARAMS = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3, "scale_pos_weight": 8}


@pytest.fixture(scope="module")
def prepared(transactions):
    return training_job.prepared(transactions)[0].persist()


@pytest.fixture(scope="module")
def boosted(prepared):
    return learners.fit(prepared.filter("split <> 'test'"), learners.BOOSTED, PARAMS)


def test_unknown_category_is_minus_one(spark):
    fit_on = spark.createDataFrame([("web",), ("app",), ("kiosk",)], "channel string")
    model = encoders.OrdinalCodes(categorical=["channel"]).fit(fit_on)
    rows = spark.createDataFrame([("app",), ("kiosk",), ("web",), ("fax",), (None,)], "channel string")
    assert [r[0] for r in model.transform(rows).select("channel_code").collect()] == [0.0, 1.0, 2.0, -1.0, -1.0]


def test_scaling_uses_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 7.0, "a"), (3.0, 7.0, "b")], "x double, k double, c string")
    out = encoders.ScaledDummies(categorical=["c"], scaled=["x", "k"]).fit(frame).transform(frame).orderBy("x").collect()
    assert [r["x_z"] for r in out] == [-1.0, 1.0]
    assert [r["k_z"] for r in out] == [0.0, 0.0]
    assert [r["c_is_b"] for r in out] == [0.0, 1.0]


def test_encoding_family_names():
    assert encoders.encoding_for("XGBoost").getStages()[0].__class__ is encoders.OrdinalCodes
    assert encoders.encoding_for("lr").getStages()[0].__class__ is encoders.ScaledDummies
    with pytest.raises(ValueError, match="svm"):
        encoders.encoding_for("svm")


@pytest.mark.parametrize(
    ("family", "params"),
    [(learners.LINEAR, {"max_iter": 30}), (learners.FOREST, {"n_estimators": 5, "max_depth": 5}), (learners.BOOSTED, PARAMS)],
)
def test_models_beat_the_positive_rate(prepared, family, params):
    model = learners.fit(prepared.filter("split = 'train'"), family, params)
    held_out = prepared.filter("split <> 'train'")
    row = metrics.evaluate(learners.scored_table(model, held_out)).first()
    rate = held_out.agg(F.avg("is_fraud")).first()[0]
    assert row["pr_auc"] > 2 * rate
    assert row["roc_auc"] > 0.6


def test_contributions_add_up(prepared, boosted):
    test = learners.predicted(boosted, prepared.filter("split = 'test'"))
    rows = bt.contributions(boosted, test, "probability_fraud").collect()
    for r in rows:
        assert r["bias"] + sum(r["contributions"]) == pytest.approx(
            math.log(r["probability_fraud"] / (1 - r["probability_fraud"])), abs=1e-9
        )


def brute_shapley(leaves, x):
    """Shapley values by summing over all feature subsets of every leaf."""
    phi = np.zeros(len(x))
    for leaf in leaves:
        m = len(leaf.features)
        hit = [float(leaf.low[i] < x[f] <= leaf.high[i]) for i, f in enumerate(leaf.features)]
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for size in range(m):
                for subset in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    term = np.prod([hit[j] if j in subset else leaf.cover[j] for j in others])
                    phi[leaf.features[i]] += leaf.value * weight * term * (hit[i] - leaf.cover[i])
    return phi


def test_contributions_match_subset_sums(prepared, boosted):
    leaves = bt.leaves_of(boosted)
    rows = bt.contributions(boosted, prepared.filter("split = 'test'").limit(20)).collect()
    for r in rows:
        assert np.allclose(r["contributions"], brute_shapley(leaves, r["values"]), atol=1e-10)


def test_long_paths_give_the_same_contributions(prepared):
    """Paths too long for a pattern table go through the direct way."""
    deep = learners.fit(prepared, learners.BOOSTED, {**PARAMS, "n_estimators": 2, "max_depth": 8})
    leaves = bt.leaves_of(deep)
    assert max(len(leaf.features) for leaf in leaves) > bt.TABLE_FEATURES
    rows = bt.contributions(deep, learners.predicted(deep, prepared), "probability_fraud").limit(200).collect()
    for r in rows:
        p = r["probability_fraud"]
        assert r["log_odds"] == pytest.approx(math.log(p / (1 - p)), abs=1e-9)
    for r in rows[:5]:
        assert np.allclose(r["contributions"], brute_shapley(leaves, r["values"]), atol=1e-10)


def test_margins_end_at_the_log_odds(prepared, boosted):
    test = learners.predicted(boosted, prepared.filter("split = 'test'"))
    rows = bt.margins_per_iteration(boosted, test, "probability_fraud").collect()
    for r in rows:
        assert len(r["margins"]) == 5
        assert 1 / (1 + math.exp(-r["margins"][-1])) == pytest.approx(r["probability_fraud"], abs=1e-12)


def test_shorter_ensemble_is_a_prefix(prepared, boosted):
    """The search scores fewer trees by cutting a longer model; a separate fit must agree."""
    params = {**PARAMS, "subsample": 0.9}
    train, test = prepared.filter("split <> 'test'"), prepared.filter("split = 'test'")
    long = learners.fit(train, learners.BOOSTED, {**params, "n_estimators": 5})
    short = learners.fit(train, learners.BOOSTED, {**params, "n_estimators": 2})
    cut = {r[0]: r[1] for r in bt.margins_per_iteration(long, test, "transaction_id").select("transaction_id", F.get("margins", F.lit(1))).collect()}
    own = {r[0]: r[1] for r in bt.margins_per_iteration(short, test, "transaction_id").select("transaction_id", F.get("margins", F.lit(1))).collect()}
    assert own == pytest.approx(cut)


def test_gain_importance_sums_to_one(boosted):
    rows = bt.gain_importance(boosted).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert {r["feature"] for r in rows} == set(fv.MODEL_COLUMNS)


def test_only_boosted_models_explain(prepared):
    model = learners.fit(prepared, learners.FOREST, {"n_estimators": 2, "max_depth": 3})
    with pytest.raises(ValueError, match="boosted"):
        bt.leaves_of(model)


def contributors(spark, values, **options):
    frame = spark.createDataFrame([(values, 0.0)], "contributions array<double>, bias double")
    return importance.top_contributors(frame, list("abcd"), **options).first()["top_contributors"]


def test_top_contributors(spark):
    top = contributors(spark, [0.5, -2.0, 0.5, 1.0])
    assert [c["feature"] for c in top] == ["d", "a", "c"]
    both = contributors(spark, [0.5, -2.0, 0.5, 1.0], only_positive=False, top_n=2)
    assert [c["feature"] for c in both] == ["b", "d"]
    assert top[0]["contribution_probability"] == pytest.approx(0.5 - 1 / (1 + math.exp(1.0)))
    assert contributors(spark, [-1.0, -2.0, 0.0, -0.1]) == []


@pytest.mark.parametrize("top_n", [0, 11])
def test_top_n_bounds(spark, top_n):
    with pytest.raises(ValueError, match="top_n"):
        contributors(spark, [1.0, 1.0, 1.0, 1.0], top_n=top_n)


def test_search_arguments():
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert len(search.candidates_of(grid)) == search.grid_size(grid) == 6
    drawn = search.candidates_of(grid, "random", n_iter=4)
    assert len({tuple(c.items()) for c in drawn}) == 4
    assert search.candidates_of(grid, "random", n_iter=4) == drawn
    assert len(search.candidates_of(grid, "random", n_iter=40)) == 6
    with pytest.raises(ValueError, match="bayes"):
        search.candidates_of(grid, "bayes")
    assert search.grid_size(fv.FOREST_GRID) == 12 and search.grid_size(fv.BOOSTED_GRID) == 48


def test_search_logs_every_metric_and_refits(prepared):
    data = prepared.filter("split <> 'test'")
    found = search.search(data, "xgb", [{**PARAMS, "n_estimators": n} for n in (1, 3)], "run", folds=2)
    log = found.log.collect()
    # two candidates, two folds: six metrics on two splits and two times
    assert len(log) == 2 * 2 * (6 * 2 + 2)
    table = experiments.candidates(found.log)
    best = experiments.best_candidates(table).first()
    assert found.best_score == best["mean_test"]
    assert str(found.best_params["n_estimators"]) == best["params"]["n_estimators"]
    assert found.model.stages[-1].getNumTrees == found.best_params["n_estimators"]


def test_iteration_tracking(prepared):
    tracking = search.iteration_tracking(prepared.filter("split <> 'test'"), PARAMS, rounds=3, folds=2)
    rows = tracking.collect()
    assert [r["iteration"] for r in rows] == [1, 2, 3]
    assert all(r["gap"] == pytest.approx(r["train_pr_auc_mean"] - r["val_pr_auc_mean"]) for r in rows)
    row = search.degradation(tracking, tuned=2).first()
    assert row["final_val_pr_auc"] == rows[-1]["val_pr_auc_mean"]
    best = search.degradation(tracking).first()
    assert best["val_pr_auc_mean"] == max(r["val_pr_auc_mean"] for r in rows)


# ---- scoring ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def deployed(spark, transactions, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("deployed") / "artifacts")
    training_job.save_all(spark, training_job.train(transactions, params=PARAMS), folder, "run-1")
    assert artifacts.load_hyperparameters(spark, "gbt", runs=f"{folder}/training_runs") == PARAMS
    return scoring_job.Deployed.load(spark, folder)


def test_bands_and_decisions(spark):
    frame = spark.createDataFrame([(0.29,), (0.3,), (0.69,), (0.7,), (None,)], "probability double")
    out = scoring.decided(frame, {"s": 0.3}, "s").collect()
    assert [r["risk_level"] for r in out] == ["low", "medium", "medium", "high", None]
    assert [r["is_fraud_predicted"] for r in out] == [0, 1, 1, 1, None]
    with pytest.raises(ValueError, match="unknown strategy"):
        scoring.decided(frame, {"s": 0.3}, "t")


def test_batch_scoring_separates_rejects(spark, sf_dir, deployed):
    requests = data_queries.broken_requests(spark, sf_dir)
    accepted, rejected = scoring_job.score_batch(requests, deployed, include_explanation=True, top_n=2)
    rows = accepted.collect()
    assert len(rows) + rejected.count() == requests.count()
    for r in rows:
        assert r["is_fraud_predicted"] == int(r["probability"] >= r["threshold_value"])
        e = r["explanation"]
        assert e["final_fraud_probability"] == pytest.approx(r["probability"], abs=1e-9)
        assert len(e["top_contributors"]) <= 2
        assert all(c["contribution_log_odds"] > 0 for c in e["top_contributors"])


def test_stream_equals_batch(spark, sf_dir, deployed, tmp_path):
    requests = data_queries.broken_requests(spark, sf_dir)
    requests.repartition(4).write.json(str(tmp_path / "in"))
    query = online.start_scoring(
        online.request_stream(spark, str(tmp_path / "in"), schemas.request_schema(), files_per_batch=2),
        deployed.stats,
        deployed.score,
        deployed.thresholds,
        str(tmp_path / "ok"),
        str(tmp_path / "bad"),
        str(tmp_path / "checkpoint"),
    )
    query.awaitTermination()
    accepted, rejected = scoring_job.score_batch(requests, deployed)
    streamed = spark.read.parquet(str(tmp_path / "ok")).drop("batch_id")
    want = accepted.select(*streamed.columns)
    assert streamed.count() == want.count()
    joined = streamed.alias("s").join(want.alias("w"), "transaction_id").filter(
        (F.abs(F.col("s.probability") - F.col("w.probability")) > 1e-12) | (F.col("s.risk_level") != F.col("w.risk_level"))
    )
    assert joined.isEmpty()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == rejected.count()


def test_saved_model_scores_raw_rows(spark, transactions, tmp_path):
    trained = training_job.train(transactions, learners.LINEAR, {"max_iter": 10})
    learners.save_model(trained.model, str(tmp_path / "m"))
    again = learners.load_model(str(tmp_path / "m")).transform(transactions)
    assert again.filter(vector_to_array("probability")[1].isNull()).isEmpty()
    assert again.count() == transactions.count()


def test_request_schema_has_text_time():
    schema = schemas.request_schema()
    assert schema["transaction_time"].dataType == T.StringType() and "is_fraud" not in schema.fieldNames()


def test_candidates_share_fits_by_acting_parameters():
    groups = search._shared_fits("boosted_trees", search.candidates_of(fv.BOOSTED_GRID))
    assert sorted(len(g) for g in groups) == [24, 24]  # one for each depth
    # the largest forest contains the first trees of the smaller ones, and their trees cut at a lower depth
    assert [len(g) for g in search._shared_fits("random_forest", search.candidates_of(fv.FOREST_GRID))] == [12]
    leaves = [{**c, "min_samples_leaf": n} for c in search.candidates_of(fv.FOREST_GRID) for n in (5, 10)]
    assert [len(g) for g in search._shared_fits("random_forest", leaves)] == [12, 12]


def shares(model, frame, sizes):
    trees = tree_models.Trees.of(model)
    rows = tree_models.vector_arrays(model, frame, ["transaction_id"])
    made = tree_models.with_lists(rows, "scores", lambda b: tree_models.forest_shares(trees, tree_models.matrix(b), sizes))
    return {r["transaction_id"]: r["scores"] for r in made.collect()}


def positive(model, frame):
    return {r["transaction_id"]: r["probability_fraud"] for r in learners.predicted(model, frame).collect()}


def test_prefix_of_a_forest_is_scored_as_its_own_forest(prepared):
    train, test = prepared.filter("split <> 'test'"), prepared.filter("split = 'test'")
    model = learners.fit(train, learners.FOREST, {"n_estimators": 7, "max_depth": 6, "min_samples_leaf": 3})
    found = shares(model, test, [(6, 7), (6, 3), (9, 1)])
    encoded = PipelineModel(model.stages[:-1]).transform(test)
    votes = {}
    for tree in model.stages[-1].trees:
        for r in tree.transform(encoded).select("transaction_id", vector_to_array("probability")[1].alias("p")).collect():
            votes.setdefault(r["transaction_id"], []).append(r["p"])
    whole = positive(model, test)
    assert found.keys() == votes.keys() and len(votes) > 100
    for key, p in votes.items():
        assert found[key] == pytest.approx([whole[key], np.mean(p[:3]), p[0]], abs=1e-12)


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_a_tree_cut_at_a_depth_is_the_tree_grown_to_it(prepared, depth):
    """One tree on all features and rows has nothing random in it, so both must agree."""
    train, test = prepared.filter("split <> 'test'"), prepared.filter("split = 'test'")
    params = {"n_estimators": 1, "max_features": "all", "min_samples_leaf": 5}
    deep, shallow = (learners.fit(train, learners.FOREST, {**params, "max_depth": d}) for d in (8, depth))
    found, want = shares(deep, test, [(depth, 1), (8, 1)]), positive(shallow, test)
    assert {k: v[0] for k, v in found.items()} == pytest.approx(want, abs=1e-12)
    assert {k: v[1] for k, v in found.items()} == pytest.approx(positive(deep, test), abs=1e-12)


def test_a_stopped_search_goes_on_where_it_was(prepared, tmp_path, monkeypatch):
    data, fits, fit = prepared.filter("split <> 'test'"), [], learners.fit

    def counted(frame, family, params=None, seed=1):
        if len(fits) == 3 and not going_on:
            raise InterruptedError
        fits.append((family, params["n_estimators"]))
        return fit(frame, family, params, seed)

    monkeypatch.setattr(learners, "fit", counted)
    grid = [{**PARAMS, "max_depth": d, "n_estimators": n} for d in (2, 3) for n in (1, 2)]
    options = {"folds": 3, "refit": None, "parallelism": 1, "log_path": str(tmp_path / "log")}
    going_on = False
    with pytest.raises(InterruptedError):
        search.search(data, "gbt", grid, "r", **options)
    assert len(fits) == 3
    going_on = True
    log = search.search(data, "gbt", grid, "r", **options).log
    assert len(fits) == 6 and log.count() == 4 * 3 * 14  # the other three fits; four candidates, three folds
    again = search.search(data, "gbt", grid, "r", **options).log
    assert len(fits) == 6 and again.drop("params").exceptAll(log.drop("params")).isEmpty()
    whole = search.search(data, "gbt", grid, "r", folds=3, refit=None).log
    facts = ["candidate_id", "fold", "split", "metric", F.round("value", 9)]
    assert whole.filter("split <> 'time'").select(*facts).exceptAll(log.select(*facts)).isEmpty()
    search.search(data, "gbt", grid[:1], "r", **options)  # other candidates are other fits
    assert len(fits) == 6 + 6 + 3


def test_gain_importance_equals_sql_over_the_node_table(boosted, tmp_path):
    boosted.stages[-1].write().save(str(tmp_path / "m"))
    rows = duckdb.execute(
        f"""WITH g AS (SELECT nodeData.split.featureIndex AS i, avg(nodeData.gain) AS g FROM '{tmp_path}/m/data/*.parquet'
        WHERE nodeData.leftChild >= 0 GROUP BY 1) SELECT i, g / sum(g) OVER () FROM g"""
    ).fetchall()
    want = {c: 0.0 for c in fv.MODEL_COLUMNS} | {fv.MODEL_COLUMNS[i]: g for i, g in rows}
    assert {r["feature"]: r["importance"] for r in bt.gain_importance(boosted).collect()} == pytest.approx(want)


def test_shared_and_blocked_scores_equal_separate_ones(prepared, monkeypatch):
    data = prepared.filter("split <> 'test'")
    whole = {r["iteration"]: r for r in search.iteration_tracking(data, PARAMS, rounds=3, folds=2).collect()}
    monkeypatch.setattr(search, "ROUNDS_PER_JOB", 2)
    for r in search.iteration_tracking(data, PARAMS, rounds=3, folds=2).collect():
        assert tuple(r) == pytest.approx(tuple(whole[r["iteration"]]), abs=1e-9)
    candidates = [{**PARAMS, "n_estimators": n, "gamma": g} for n in (1, 2, 3) for g in (0.6, 0.7)]
    log = search.search(data, "xgb", candidates, "run", folds=2, refit=None).log.filter("metric = 'pr_auc' AND split = 'test'")
    means = {r[0]: r[1] for r in log.groupBy("candidate_id").avg("value").collect()}
    assert len(means) == 6 and all(abs(means[i] - whole[i // 2 + 1]["val_pr_auc_mean"]) < 1e-9 for i in means)


def test_registered_searches_run_the_whole_grids(monkeypatch):
    seen = {}

    def record(kind):
        def run(*args, **options):
            seen[kind] = (args[1:], options)
            raise InterruptedError

        return run

    monkeypatch.setattr(model_queries, "prepared", lambda spark, sf: spark)
    for kind in ("search", "tree_count_search", "iteration_tracking"):
        monkeypatch.setattr(search, kind, record(kind))

    class Rows:
        def filter(self, _):
            return self

    def asked(query, kind):
        with pytest.raises(InterruptedError):
            query(Rows(), "")
        args, options = seen[kind]
        assert not {"folds", "rounds"} & set(options)  # CV_FOLDS and 200 are the defaults
        return args

    assert asked(model_queries.m7, "search")[1] == search.candidates_of(fv.FOREST_GRID)
    assert asked(model_queries.m7_boosted, "search")[1] == search.candidates_of(fv.BOOSTED_GRID)
    assert len(asked(model_queries.m8, "search")[1]) == 10
    assert asked(model_queries.m7_counts, "tree_count_search")[2] == fv.BOOSTED_TREE_COUNTS
    assert asked(model_queries.m12, "iteration_tracking") == asked(model_queries.m12_degradation, "iteration_tracking") == (fv.TUNED_BOOSTED,)


def test_a_million_values_are_ranked_where_they_lie(spark):
    """Codes in the order of the texts; a model refuses to hold so many categories."""
    n = 1_000_000
    frame = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("c"), F.lit(None).cast("string").alias("none"))
    frame = frame.unionByName(frame.limit(1000)).unionByName(spark.createDataFrame([(None, None)], frame.schema))
    codes, found = importance.ranked_values(frame, "c")
    assert found == n == codes.count()
    r = codes.agg(F.min("code"), F.max("code"), F.countDistinct("code"), F.min_by("value", "code"), F.max_by("value", "code"), F.min("value"), F.max("value")).first()
    assert tuple(r[:3]) == (0.0, n - 1.0, n) and (r[3], r[4]) == (r[5], r[6])
    some = sorted((x["value"], x["code"]) for x in codes.filter("value LIKE '12%'").collect())
    assert len(some) > 3000 and [c for _, c in some] == sorted(c for _, c in some) and some[-1][1] - some[0][1] == len(some) - 1
    empty, none = importance.ranked_values(frame, "none")
    assert none == 0 and empty.count() == 0
    with pytest.raises(ValueError, match="100000 values"):
        encoders.OrdinalCodes(categorical=["c"]).fit(frame)


def test_diagnostics_of_a_replayed_run_replace_its_own_rows(spark, sf_dir, tmp_path):
    log, path = warehouse.candidate_log(spark, sf_dir), str(tmp_path / "diagnostics")
    counts = lambda: {n: {r["run_id"]: r["count"] for r in artifacts.load_diagnostic(spark, path, n, "run_id string").groupBy("run_id").count().collect()} for n in artifacts.DIAGNOSTICS}
    artifacts.save_run_diagnostics(log, path)
    once = counts()
    assert all(len(runs) == 5 for runs in once.values())
    artifacts.save_run_diagnostics(log.filter("run_id = '1' AND candidate_id < 7"), path)
    assert {n: {k: v for k, v in runs.items() if k != "1"} for n, runs in counts().items()} == {n: {k: v for k, v in runs.items() if k != "1"} for n, runs in once.items()}
    assert counts()["cv_results"]["1"] == 14 and counts()["fold_details"]["1"] == 14 * 4
    with pytest.raises(ValueError, match="unknown diagnostic"):
        artifacts.load_diagnostic(spark, path, "other", "run_id string")


def test_explained_rows_are_those_of_the_job(monkeypatch):
    class Rows:
        def filter(self, condition):
            return condition

    class Model:
        stages = ("features", "codes", "trees")

    class Job:
        model, data = Model, Rows()

    monkeypatch.setattr(model_queries, "tuned_job", lambda spark, sf: Job)
    monkeypatch.setattr(model_queries, "PipelineModel", list)
    monkeypatch.setattr(model_queries, "prepared", None)  # the features are not made a second time
    assert model_queries.fitted_boosted(None, "") == (["codes", "trees"], "split = 'test'")
