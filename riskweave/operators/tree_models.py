"""Fitted tree ensembles as tables: the node table of a saved model, and its trees applied to Arrow batches of rows.

The number of nodes depends on the model's parameters only (trees x 2^depth), so the arrays of ``Trees`` travel to the tasks;
rows stay where they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources.scratch import scratch_path

SAVED_NODE = (
    "treeID int, nodeData struct<id:int,prediction:double,impurityStats:array<double>,gain:double,leftChild:int,"
    "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
ROWS_AT_ONCE = 4_096  # rows that walk down a tree together
TREES_AT_ONCE = 50  # trees that one step of a batch walks down


def tree_stage(model: Model) -> Model:
    found = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not isinstance(found, (GBTClassificationModel, RandomForestClassificationModel)):
        raise ValueError("need a boosted-tree or forest model")
    return found


def nodes_at(spark: SparkSession, path: str) -> DataFrame:
    """The node table of an ensemble stored at ``path``: one row a node, numbered from 0 within its tree.

    ``stats`` are the node's class weights in a forest; in a boosted model the first is its weight.  Leaves have no feature.
    """
    n = "nodeData."
    inner = F.col(n + "leftChild") >= 0
    return spark.read.schema(SAVED_NODE).parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col(n + "id").alias("node"),
        F.col(n + "prediction").alias("prediction"),
        F.col(n + "impurityStats").alias("stats"),
        F.when(inner, F.col(n + "gain")).alias("gain"),
        F.when(inner, F.col(n + "leftChild")).alias("left"),
        F.when(inner, F.col(n + "rightChild")).alias("right"),
        F.when(inner, F.col(n + "split.featureIndex")).alias("feature"),
        F.when(inner & (F.col(n + "split.numCategories") == -1), F.get(n + "split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
    )


def node_table(model: Model) -> DataFrame:
    """``nodes_at`` for a model in memory: its tree stage is saved to the scratch folder first."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    tree_stage(model).write().save(path)
    return nodes_at(spark, path)


def gain_by_feature(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean gain per split of each feature, scaled to sum to one, highest first; an unused feature has 0."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "index int, feature string")
    found = nodes.filter(F.col("feature").isNotNull()).groupBy(F.col("feature").alias("index")).agg(F.avg("gain").alias("mean_gain"))
    total = found.agg(F.sum("mean_gain")).scalar()  # one number of a table with a row a feature
    share = F.when(total > 0, F.coalesce("mean_gain", F.lit(0.0)) / total).otherwise(F.lit(0.0))
    return names.join(found, "index", "left").select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")


@dataclass
class Trees:
    """All nodes of an ensemble in arrays, tree after tree; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    level: np.ndarray
    value: np.ndarray  # boosted: log-odds that the tree adds; forest: share of the positive class
    prediction: np.ndarray
    cover: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(model: Model) -> Trees:
        stage = tree_stage(model)
        boosted = isinstance(stage, GBTClassificationModel)
        cover = F.get("stats", F.lit(0)) if boosted else F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
        share = F.get("stats", F.lit(1)) / cover
        table = node_table(stage).select(
            "tree", "node", "left", "right", "feature", "threshold", "prediction", cover.alias("cover"),
            (F.col("prediction") if boosted else share).alias("value"),
        )
        found = table.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        column = lambda name, none: found.column(name).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
        tree, own = column("tree", 0), np.arange(found.num_rows)
        roots = np.flatnonzero(np.diff(tree, prepend=-1))
        start = roots[tree]
        leaf = column("left", -1) < 0
        if np.isnan(column("threshold", np.nan)[~leaf]).any():
            raise ValueError("trees with categorical splits are not supported")
        left = np.where(leaf, own, start + column("left", 0))
        right = np.where(leaf, own, start + column("right", 0))
        level = np.zeros(len(own), np.int64)
        for i in own:  # children come after their parent
            if not leaf[i]:
                level[[left[i], right[i]]] = level[i] + 1
        weights = 2.0 * np.array(stage.treeWeights) if boosted else np.ones(len(roots))
        return Trees(
            roots, column("feature", 0).astype(np.int64), column("threshold", np.inf), left, right, level,
            column("value", 0.0) * weights[tree], column("prediction", 0.0), column("cover", 0.0), leaf,
        )

    @property
    def deepest(self) -> int:
        return int(self.level.max(initial=0))

    @functools.cached_property
    def steps(self) -> list[int]:
        """The depth of each tree."""
        return np.maximum.reduceat(self.level, self.roots).tolist()

    @functools.cached_property
    def children(self) -> np.ndarray:
        """Left and right of node 0, of node 1, and so on."""
        return np.stack([self.left, self.right], axis=1).reshape(-1)

    def cut(self, depth: int) -> np.ndarray:
        """For each node the leaf it falls in when no tree grows deeper than ``depth``.

        Leaves of one parent that predict the same class are one leaf, as Spark joins them after growing.
        """
        leaf = self.leaf | (self.level >= depth)
        for d in range(min(depth, self.deepest) - 1, -1, -1):
            at = np.flatnonzero((self.level == d) & ~leaf)
            a, b = self.left[at], self.right[at]
            leaf[at[leaf[a] & leaf[b] & (self.prediction[a] == self.prediction[b])]] = True
        stop = np.arange(len(leaf))
        for d in range(self.deepest):  # from the root down: below a leaf everything falls in it
            at = np.flatnonzero((self.level == d) & ~self.leaf)
            at = at[leaf[at] | (stop[at] != at)]
            stop[self.left[at]] = stop[self.right[at]] = stop[at]
        return stop

    def reached(self, values: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The leaf of every row (rows x trees ``first`` to ``last``).  A missing value takes the right branch."""
        roots = self.roots[first:last]
        out = np.empty((len(values), len(roots)), np.int64)
        child, steps = self.children, self.steps
        for s in range(0, len(values), ROWS_AT_ONCE):  # as many rows as a core's own cache holds, one tree after the other
            part = values[s : s + ROWS_AT_ONCE]
            flat, n = np.ascontiguousarray(part.T).reshape(-1), len(part)
            row = np.arange(n)
            for t, root in enumerate(roots.tolist()):
                at = np.full(n, root)
                for _ in range(steps[first + t]):
                    cell = self.feature.take(at)
                    cell *= n
                    cell += row
                    small = flat.take(cell) <= self.threshold.take(at)
                    at *= 2
                    at += ~small
                    at = child.take(at)
                out[s : s + n, t] = at
        return out


# ---- rows ----


def vector_arrays(model: PipelineModel, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., values): the encoded features of every row as an array."""
    return PipelineModel(model.stages[:-1]).transform(frame).select(*keep, vector_to_array("features").alias("values"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The ``values`` lists of a batch as a rows x features matrix."""
    flat = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def with_lists(frame: DataFrame, name: str, made) -> DataFrame:
    """``frame`` with the rows of the matrix ``made(batch)`` in a new array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(made(batch))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def margins(trees: Trees, values: np.ndarray, first: int, last: int) -> np.ndarray:
    """What trees ``first`` to ``last`` of a boosted model add, summed up tree by tree."""
    return trees.value[trees.reached(values, first, last)].cumsum(axis=1)


def forest_shares(trees: Trees, values: np.ndarray, sizes: Sequence[tuple[int, int]]) -> np.ndarray:
    """For each (depth, n) of ``sizes``: the share of the positive class by the first n trees, cut at that depth."""
    total = {d: np.zeros((len(values), len(trees.roots))) for d, _ in sizes}
    stops = {d: trees.cut(d) for d in total}
    for s in range(0, len(trees.roots), TREES_AT_ONCE):
        leaf = trees.reached(values, s, s + TREES_AT_ONCE)
        for d, shares in total.items():
            shares[:, s : s + TREES_AT_ONCE] = trees.value[stops[d][leaf]]
    sums = {d: shares.cumsum(axis=1) for d, shares in total.items()}
    return np.stack([sums[d][:, n - 1] / n for d, n in sizes], axis=1)

