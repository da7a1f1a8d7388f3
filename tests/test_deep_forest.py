"""Forests of unlimited depth: the two ways to grow a node, Spark's own trees, and what Spark's learner is given."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import deep_forest, learners

COMMON = {"labelCol": "is_fraud", "weightCol": "weight", "maxBins": 256, "seed": 3}


@pytest.fixture(scope="module")
def rows(spark):
    """1,200 rows of four features with up to 61 values; the label follows three of them, with noise."""
    k = F.col("id")
    cells = [(k * 7919 % 61).cast("double"), (k * 104729 % 37 / 4).cast("double"), (F.hash(k) % 29).cast("double"), (k % 2).cast("double")]
    risk = (F.col("f0") > 40) & (F.col("f1") < 6) | (F.col("f2") > 20) & (F.col("f3") == 1) | (F.pmod(F.xxhash64("id"), F.lit(19)) == 0)
    frame = spark.range(1200).select("id", *[c.alias(f"f{i}") for i, c in enumerate(cells)])
    frame = frame.withColumn("is_fraud", risk.cast("int")).withColumn("weight", F.when(risk, 2.5).otherwise(0.75))
    return VectorAssembler(inputCols=["f0", "f1", "f2", "f3"], outputCol="features").transform(frame).persist()


def shares(model, rows):
    found = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
    return {r["id"]: r["p"] for r in found.collect()}


def test_a_limit_of_rows_does_not_change_the_forest(rows):
    forest = RandomForestClassifier(numTrees=3, maxDepth=30, featureSubsetStrategy="all", **COMMON)
    whole, cut = (deep_forest.fit(rows, forest, small=n) for n in (10_000, 60))
    assert whole.totalNumNodes == cut.totalNumNodes > 100
    assert shares(whole, rows) == pytest.approx(shares(cut, rows), abs=1e-12)
    assert [t.depth for t in whole.trees] == [t.depth for t in cut.trees]


@pytest.mark.parametrize("small", [10_000, 100])
def test_a_tree_without_chance_is_sparks_own(rows, small):
    tree = RandomForestClassifier(numTrees=1, maxDepth=4, minInstancesPerNode=15, bootstrap=False, featureSubsetStrategy="all", **COMMON)
    ours, theirs = deep_forest.fit(rows, tree, small=small), tree.fit(rows)
    assert ours.totalNumNodes == theirs.totalNumNodes
    assert shares(ours, rows) == pytest.approx(shares(theirs, rows), abs=1e-9)


def test_a_tree_grows_until_its_leaves_are_pure(rows):
    tree = RandomForestClassifier(numTrees=1, maxDepth=30, bootstrap=False, featureSubsetStrategy="all", **COMMON)
    found = shares(deep_forest.fit(rows.dropDuplicates(["f0", "f1", "f2", "f3"]), tree, small=200), rows.dropDuplicates(["f0", "f1", "f2", "f3"]))
    labels = {r["id"]: r["is_fraud"] for r in rows.select("id", "is_fraud").collect()}
    assert all((p > 0.5) == (labels[i] == 1) for i, p in found.items())


def test_weights_must_follow_the_label(rows):
    with pytest.raises(ValueError, match="equal within a class"):
        deep_forest.fit(rows.withColumn("weight", F.col("id") + 1.0), RandomForestClassifier(numTrees=1, **COMMON))


def test_an_unlimited_forest_keeps_no_dense_counts_of_deep_nodes(spark, transactions, monkeypatch):
    """Spark's learner, which sends counts of all bins for every node from every partition, is given two rows."""
    from riskweave.plans import training_job

    given, spark_fit = [], RandomForestClassifier._fit

    def seen(self, dataset):
        given.append(dataset.count())
        return spark_fit(self, dataset)

    monkeypatch.setattr(RandomForestClassifier, "_fit", seen)
    data, _ = training_job.prepared(transactions)
    model = learners.fit(data, learners.FOREST, {"n_estimators": 4})
    assert given == [2]
    assert model.stages[-1].getNumTrees == 4 and model.stages[-1].getOrDefault("maxDepth") == 30
    assert max(t.depth for t in model.stages[-1].trees) > 5
    learners.fit(data, learners.FOREST, {"n_estimators": 2, "max_depth": 5})
    assert given == [2, data.count()]
