"""Score raw transactions: validate, engineer, predict, decide, explain.  Used for batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import boosted_trees, importance, learners, scoring, validation
from riskweave.operators.features import FittedStatistics, engineered
from riskweave.sources import artifacts

Scorer = Callable[[DataFrame], DataFrame]


def with_features(valid: DataFrame, stats: FittedStatistics) -> DataFrame:
    """Valid text-time requests to engineered rows."""
    return engineered(validation.with_upper_countries(validation.with_utc_time(valid)), stats)


@dataclass
class Deployed:
    """A stored training run, ready to score."""

    stats: FittedStatistics
    model: PipelineModel
    thresholds: Mapping[str, float]
    base_rate: float

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Deployed:
        strategies = spark.read.parquet(f"{folder}/strategies")
        run = artifacts.load_training_runs(spark, f"{folder}/training_runs").orderBy(F.col("trained_at").desc()).first()
        whole = learners.load_model(f"{folder}/model")
        return Deployed(
            FittedStatistics.load(spark, f"{folder}/statistics"),
            PipelineModel(whole.stages[1:]),  # features are engineered here, from the stored statistics
            scoring.strategy_thresholds(strategies),
            run["positive_rates"]["train_validation"],
        )

    def score(self, featured: DataFrame) -> DataFrame:
        return learners.predicted(self.model, featured, "probability")

    def explain(self, scored: DataFrame, top_n: int = 3) -> DataFrame:
        kept = scored.columns
        rows = boosted_trees.contributions(self.model, scored, *kept)
        top = importance.top_contributors(rows, top_n=top_n, values=F.col("values"))
        return importance.with_explanation(top, self.base_rate).select(*kept, "explanation")


def score_batch(
    requests: DataFrame,
    deployed: Deployed,
    strategy: str = "target_performance",
    include_explanation: bool = False,
    top_n: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(output records, rejected rows) of a table of raw requests."""
    checked = validation.checked(requests)
    featured = with_features(validation.valid_rows(checked), deployed.stats)
    scored = deployed.score(featured)
    extra = []
    if include_explanation:
        scored = deployed.explain(scored, top_n)
        extra = ["explanation"]
    records = scoring.output_records(scoring.decided(scored, deployed.thresholds, strategy), *extra)
    return records, validation.rejected_rows(checked)
