"""Boosted trees from summed counts: Spark's own trees, blocks made anew, shared codes, and what Spark's learner is given."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import boosting, learners
from riskweave.operators.tree_models import node_table

COMMON = {"labelCol": "is_fraud", "weightCol": "weight", "maxBins": 256, "seed": 3}
NAMES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    """1,500 rows of five features of 2 to 61 values; the label follows three of them, with noise."""
    k = F.col("id")
    cells = [(k * 7919 % 61), (k * 104729 % 37 / 4), (F.hash(k) % 29), (k % 2), (k % 3)]
    risk = (F.col("f0") > 40) & (F.col("f1") < 6) | (F.col("f2") > 20) & (F.col("f3") == 1) | (F.pmod(F.xxhash64("id"), F.lit(19)) == 0)
    frame = spark.range(1500).select("id", *[c.cast("double").alias(f"f{i}") for i, c in enumerate(cells)])
    frame = frame.withColumn("is_fraud", risk.cast("int")).withColumn("weight", F.when(risk, 2.5).otherwise(0.75))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame).persist()


def shares(model, rows):
    found = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
    return {r["id"]: r["p"] for r in found.collect()}


def nodes(model):
    return [tuple(r) for r in node_table(model).orderBy("tree", "node").collect()]


def test_trees_without_chance_are_sparks_own(rows):
    learner = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.1, minInstancesPerNode=7, **COMMON)
    ours, theirs = boosting.fit(rows, learner), learner.fit(rows)
    assert ours.totalNumNodes == theirs.totalNumNodes
    assert ours.treeWeights == theirs.treeWeights
    assert shares(ours, rows) == pytest.approx(shares(theirs, rows), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    table = lambda m: np.array(sorted((r["tree"], *r["stats"], r["prediction"]) for r in node_table(m).collect()))
    assert np.allclose(table(ours), table(theirs), rtol=0, atol=1e-6)


def test_blocks_made_anew_go_on_where_the_last_tree_ended(rows, monkeypatch):
    learner = GBTClassifier(maxIter=7, maxDepth=3, subsamplingRate=0.7, featureSubsetStrategy="0.6", **COMMON)
    whole = nodes(boosting.fit(rows, learner))
    monkeypatch.setattr(boosting, "TREES_APART", 2)
    assert nodes(boosting.fit(rows, learner)) == whole


def test_missing_values_go_right_and_features_share_codes():
    codes = boosting.Codes([np.array([0.5]), np.array([0.5, 1.5]), np.arange(200.0), np.array([])], 256)
    made = codes.of(np.array([[0.0, 2.0, 7.0, 1.0], [np.nan, 1.0, np.nan, np.nan]]))
    assert codes.columns == 2 and made.shape == (2, 2)
    found = [[int(codes.bins(f)[v]) for f, v in enumerate(made[codes.column, i])] for i in range(2)]
    assert found == [[0, 2, 7, 0], [1, 1, 200, 0]]
    sums = np.zeros((2, 256))
    np.add.at(sums, (np.arange(2)[:, None], made), 1.0)
    assert codes.by_feature(sums, 1).tolist() == [0, 1, 1]


def test_the_training_job_does_not_fit_by_sparks_dense_statistics(spark, rows, monkeypatch):
    seen, real = [], GBTClassifier._fit

    def counted(self, dataset):
        seen.append(dataset.count())
        return real(self, dataset)

    monkeypatch.setattr(GBTClassifier, "_fit", counted)
    monkeypatch.setattr(learners, "tree_encoding", lambda: Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features")]))
    learners.fit(rows.drop("features", "weight"), learners.BOOSTED, {"n_estimators": 2, "max_depth": 2})
    assert seen == [2]
