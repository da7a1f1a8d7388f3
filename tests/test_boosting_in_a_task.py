"""Fits whose rows meet in one task: the trees of the jobs a level, no job for each tree; cuts in one pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskweave.operators import boosting, deep_forest
from riskweave.operators.tree_models import node_table

COMMON = {"labelCol": "is_fraud", "weightCol": "weight", "maxBins": 256, "seed": 3}
NAMES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    cells = [(k * 7919 % 61), (k * 104729 % 37 / 4), (F.pmod(F.hash(k), F.lit(1009)) / 7), (k % 2), (k % 3)]
    risk = (F.col("f0") > 40) & (F.col("f1") < 6) | (F.col("f2") > 90) & (F.col("f3") == 1) | (F.pmod(F.xxhash64("id"), F.lit(19)) == 0)
    frame = spark.range(3000).select("id", *[c.cast("double").alias(f"f{i}") for i, c in enumerate(cells)])
    frame = frame.withColumn("is_fraud", risk.cast("int")).withColumn("weight", F.when(risk, 2.5).otherwise(0.75))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame).persist()


def numbers(model):
    return np.array([(r["tree"], r["node"], *r["stats"], r["prediction"], r["feature"] or 0, r["threshold"] or 0.0) for r in node_table(model).orderBy("tree", "node").collect()])


def test_one_task_grows_the_trees_of_many_jobs(rows, monkeypatch):
    learner = GBTClassifier(maxIter=6, maxDepth=4, subsamplingRate=0.7, featureSubsetStrategy="0.6", minInstancesPerNode=5, **COMMON)
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 500)
    here = numbers(boosting.fit(rows, learner))
    monkeypatch.setattr(boosting, "HELD", 0)
    jobs = numbers(boosting.fit(rows, learner))
    assert here.shape == jobs.shape and np.allclose(here, jobs, rtol=1e-9, atol=1e-9)


def test_trees_that_keep_their_rows_need_no_jobs_of_their_own(spark, rows):
    def jobs(trees):
        group = f"trees-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit(rows, GBTClassifier(maxIter=trees, maxDepth=3, **COMMON))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(7)


def test_cuts_are_near_the_quantiles_or_between_all_values(spark, monkeypatch):
    monkeypatch.setattr(deep_forest, "ROWS_OF_SUMMARY", 3000)
    made = np.random.default_rng(2)
    x = np.stack([made.normal(size=20_000), made.integers(0, 9, 20_000) * 1.0, np.where(made.random(20_000) < 0.4, 5.0, made.random(20_000)), np.full(20_000, np.nan)], axis=1)
    frame = spark.createDataFrame([(r,) for r in x.tolist()], "values array<double>").repartition(3)
    cuts = deep_forest.cuts_of(frame, 4, 16)
    for i in (0, 2):
        seen = np.sort(x[:, i])
        at = np.searchsorted(seen, cuts[i], side="right") / len(seen)
        exact = [np.mean(seen <= q) for q in np.unique(np.quantile(seen, np.arange(1, 16) / 16))]
        assert cuts[i][0] == seen[0] and np.abs(at[1:] - exact[: len(at) - 1]).max() < 1 / 128 + 1e-3
    assert cuts[1].tolist() == [k + 0.5 for k in range(8)] and cuts[3].tolist() == []
