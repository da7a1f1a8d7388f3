"""Trees grown whole by tasks that hold all rows: no job a level, the trees of the distributed way, one share for each task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import deep_forest, learners, search

COMMON = {"labelCol": "is_fraud", "weightCol": "weight", "maxBins": 256, "seed": 3}


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    cells = [(k * 7919 % 61).cast("double"), (k * 104729 % 37 / 4).cast("double"), (F.hash(k) % 29).cast("double"), (k % 2).cast("double")]
    risk = (F.col("f0") > 40) & (F.col("f1") < 6) | (F.col("f2") > 20) & (F.col("f3") == 1) | (F.pmod(F.xxhash64("id"), F.lit(19)) == 0)
    frame = spark.range(1500).select("id", *[c.alias(f"f{i}") for i, c in enumerate(cells)])
    frame = frame.withColumn("is_fraud", risk.cast("int")).withColumn("weight", F.when(risk, 2.5).otherwise(0.75))
    return VectorAssembler(inputCols=["f0", "f1", "f2", "f3"], outputCol="features").transform(frame).persist()


def shares(model, rows):
    return {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_whole_trees_are_those_of_the_distributed_way(rows, monkeypatch):
    forest = RandomForestClassifier(numTrees=7, maxDepth=9, minInstancesPerNode=4, featureSubsetStrategy="all", **COMMON)
    whole = deep_forest.fit(rows, forest, small=50)
    monkeypatch.setattr(deep_forest, "HELD", 0)
    apart = deep_forest.fit(rows, forest, small=50)
    assert whole.totalNumNodes == apart.totalNumNodes > 50
    assert shares(whole, rows) == pytest.approx(shares(apart, rows), abs=1e-12)


def test_large_nodes_need_no_jobs_of_their_own(spark, rows):
    """With a small limit many levels of nodes are large."""

    def jobs(small):
        group = f"nodes-{small}"
        spark.sparkContext.setJobGroup(group, group)
        deep_forest.fit(rows, RandomForestClassifier(numTrees=2, maxDepth=20, featureSubsetStrategy="all", **COMMON), small=small)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(10) == jobs(10_000)


def test_counting_every_bin_finds_the_cut_of_the_sorted_rows():
    made = np.random.default_rng(4)
    bins, count = made.integers(0, 8, (900, 3)).astype(np.uint8), made.integers(1, 4, 900)
    label = ((bins[:, 0] > 4) & (bins[:, 1] < 3) | (made.random(900) < 0.1)).astype(np.int64)
    cuts = [np.arange(7.0) + 0.5] * 3
    rules = [deep_forest.Rules(1, 12, 3, 3, cuts, b, 2, (500, 400), (1.0, 3.0), 5) for b in (8, 100_000)]  # counts for large nodes; sorted rows only
    dense, sparse = (deep_forest.subtree(bins, label, count, 12, r, [1]) for r in rules)
    assert all(np.array_equal(dense[k], sparse[k]) for k in ("left", "right", "feature", "cut", "n0", "n1")) and len(dense["left"]) > 30


def test_a_search_grows_its_forests_in_tasks_of_its_own(spark, transactions, monkeypatch):
    """Spark's learner, which counts a group of nodes a job, is given two rows by a search."""
    from riskweave.plans import training_job

    given, spark_fit = [], RandomForestClassifier._fit

    def seen(self, dataset):
        given.append(dataset.count())
        return spark_fit(self, dataset)

    monkeypatch.setattr(RandomForestClassifier, "_fit", seen)
    data = training_job.prepared(transactions)[0].filter("split <> 'test'")
    found = search.search(data, learners.FOREST, [{"n_estimators": 3, "max_depth": 4}, {"n_estimators": 2, "max_depth": 3}], "few", folds=2)
    assert set(given) == {2} and found.model.stages[-1].getNumTrees in (2, 3)
