"""The training job: split, fit features on train, fit the model on train + validation, evaluate, store."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import boosted_trees, importance, learners, metrics, thresholds
from riskweave.operators.curves import curve_of
from riskweave.operators.featurizer import TransactionFeaturizer, TransactionFeaturizerModel
from riskweave.operators.splits import split_summary, train_val_test
from riskweave.sources import artifacts
from riskweave.sources.scratch import spread, staged

CARRIED = ["transaction_id", "split", "is_fraud"]


@dataclass
class Trained:
    """Everything a training run yields.  Frames are stored tables; the model scores raw rows."""

    model: PipelineModel
    featurizer: TransactionFeaturizerModel
    scored_test: DataFrame
    test_metrics: dict
    strategies: DataFrame
    importance: DataFrame | None
    samples: dict
    positive_rates: dict
    imbalance: float
    params: dict
    data: DataFrame  # all rows with split and features
    raw: DataFrame  # all rows with split, before features


def prepared(raw: DataFrame, seed: int = fv.DEFAULT_SEED) -> tuple[DataFrame, TransactionFeaturizerModel]:
    """Split rows with their final features (statistics from train only), stored once."""
    return _featured(split_rows(raw, seed))


def split_rows(raw: DataFrame, seed: int = fv.DEFAULT_SEED) -> DataFrame:
    """Raw rows with their split, stored once."""
    return staged(train_val_test(raw, "is_fraud", seed=seed), "split")


def _featured(placed: DataFrame) -> tuple[DataFrame, TransactionFeaturizerModel]:
    featurizer = TransactionFeaturizer(keepColumns=CARRIED).fit(placed.filter("split = 'train'"))
    return staged(spread(featurizer.transform(placed)), "features"), featurizer


def evaluated(model: PipelineModel, frame: DataFrame, model_name: str, dataset_name: str) -> DataFrame:
    """All metrics and confusion counts of a model on a labelled feature frame, tagged with both names."""
    tagged = learners.scored_table(model, frame).withColumns(
        {"model": F.lit(model_name), "dataset": F.lit(dataset_name)}
    )
    return metrics.evaluate(staged(tagged, "scored"), ["model", "dataset"])  # the metrics read the scores several times


def train(
    raw: DataFrame, family: str = learners.BOOSTED, params: Mapping | None = None, seed: int = fv.DEFAULT_SEED
) -> Trained:
    family = learners.family_of(family)
    params = dict(fv.TUNED_BOOSTED if params is None and family == learners.BOOSTED else params or {})
    placed = split_rows(raw, seed)
    data, featurizer = _featured(placed)
    fitting, test = data.filter("split <> 'test'"), data.filter("split = 'test'")
    model = learners.fit(fitting, family, params, seed)
    scored = staged(learners.scored_table(model, test, "transaction_id"), "scored")
    found = metrics.evaluate(scored).first().asDict()
    strategies = staged(thresholds.all_strategies(curve_of(scored)), "strategies")
    ranked = None
    if family == learners.BOOSTED:
        explained = boosted_trees.contributions(model, test, "transaction_id")
        ranked = staged(importance.global_importance(explained), "importance")
    parts = {r["split"]: r for r in split_summary(data).collect()}
    n = {s: parts[s]["n_rows"] for s in parts}
    pos = {s: parts[s]["positives"] for s in parts}
    fit_rows, fit_pos = n["train"] + n["validation"], pos["train"] + pos["validation"]
    return Trained(
        PipelineModel([featurizer, *model.stages]),
        featurizer,
        scored,
        found,
        strategies,
        ranked,
        {**n, "train_validation": fit_rows},
        {"train": pos["train"] / n["train"], "train_validation": fit_pos / fit_rows, "test": pos["test"] / n["test"]},
        (fit_rows - fit_pos) / fit_pos,
        params,
        data,
        placed,
    )


def save_all(spark: SparkSession, trained: Trained, folder: str, run_id: str, family: str = learners.BOOSTED) -> None:
    """Store model, statistics, strategies, importance and the run record below one folder."""
    learners.save_model(trained.model, f"{folder}/model")
    trained.featurizer.statistics().save(spark, f"{folder}/statistics")
    thresholds.strategy_artifact(trained.strategies).coalesce(1).write.mode("overwrite").parquet(f"{folder}/strategies")
    if trained.importance is not None:
        artifacts.save_diagnostics(
            trained.importance.withColumn("run_id", F.lit(run_id)), f"{folder}/importance"
        )
    record = artifacts.training_run(
        spark,
        run_id,
        family,
        trained.params,
        trained.samples,
        trained.positive_rates,
        trained.imbalance,
        trained.test_metrics,
        note="trained on train and validation rows, evaluated on held-out test rows",
    )
    artifacts.append_training_run(record, f"{folder}/training_runs")
