"""Explanations of a fitted boosted-tree model: per-row contributions, margins per iteration, gain.

A leaf is described by its path: for every feature on it an interval the value must lie in
and the share of training cover that takes the path.  The number of leaves depends on the
model only (trees x 2^depth), so the leaf list travels to the tasks; rows stay where they are
and are handled in Arrow batches.  Rows of a batch that answer all tests of a tree alike share
its contributions, so a tree costs as many additions as it has different answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators.tree_models import Trees, gain_by_feature, margins, matrix, node_table, vector_arrays, with_lists


@dataclass
class Leaf:
    tree: int
    value: float  # leaf value times tree weight, as log-odds
    features: np.ndarray
    low: np.ndarray  # value > low
    high: np.ndarray  # value <= high
    cover: np.ndarray  # share of cover along the path, per feature
    table: np.ndarray | None = None  # contributions by hit pattern, for short paths

    @property
    def bits(self) -> np.ndarray:
        return np.arange(len(self.features))


TABLE_FEATURES = 5  # paths up to this length get a table: at most 32 patterns
WORD_TESTS = 62  # answers that one number holds


def boosted_stage(model: PipelineModel | GBTClassificationModel) -> GBTClassificationModel:
    if isinstance(model, GBTClassificationModel):
        return model
    found = model.stages[-1]
    if not isinstance(found, GBTClassificationModel):
        raise ValueError("contributions need a boosted-tree model")
    return found


def leaves_of(model: PipelineModel | GBTClassificationModel, trees: Trees | None = None) -> list[Leaf]:
    """All leaves of the ensemble.  log-odds = 2 x sum of weighted tree outputs."""
    trees = trees or Trees.of(boosted_stage(model))
    out: list[Leaf] = []
    for t, root in enumerate(trees.roots.tolist()):
        stack = [(root, {})]  # (node, {feature: (low, high, cover share)})
        while stack:
            node, path = stack.pop()
            if trees.leaf[node]:
                names = sorted(path)
                columns = [np.array([path[f][i] for f in names], dtype=float) for i in range(3)]
                leaf = Leaf(t, float(trees.value[node]), np.array(names, dtype=int), *columns)
                if 0 < len(names) <= TABLE_FEATURES:
                    leaf.table = _pattern_contributions(leaf, np.arange(1 << len(names)))
                out.append(leaf)
                continue
            feature, cut = int(trees.feature[node]), float(trees.threshold[node])
            for child, is_left in ((int(trees.left[node]), True), (int(trees.right[node]), False)):
                low, high, cover = path.get(feature, (-np.inf, np.inf, 1.0))
                bounds = (low, min(high, cut)) if is_left else (max(low, cut), high)
                share = trees.cover[child] / trees.cover[node]
                stack.append((child, {**path, feature: (*bounds, cover * share)}))
    return out


def _hits(leaf: Leaf, values: np.ndarray) -> np.ndarray:
    """Whether each row meets the path's condition on each of its features."""
    x = values[:, leaf.features]
    # a missing value fails every "x <= cut" test, so it always takes the right branch
    return ~(x <= leaf.low) & ((x <= leaf.high) | np.isposinf(leaf.high))


def _leaf_contributions(leaf: Leaf, hits: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for rows of hit patterns.

    The weighted sum over feature subsets equals the integral over t in [0, 1] of the product
    of t * hit + (1 - t) * cover over the other features; it is a polynomial in t, so Gauss
    quadrature with enough nodes is exact.
    """
    m = len(leaf.features)
    nodes, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
    t, w = (nodes + 1) / 2, weights / 2
    o = hits.astype(float)[:, :, None]
    z = leaf.cover[None, :, None]
    factors = o * t + z * (1 - t)  # rows x features x nodes
    out = np.empty(hits.shape)
    for i in range(m):
        others = np.delete(factors, i, axis=1).prod(axis=1)
        out[:, i] = leaf.value * (o[:, i, 0] - z[:, i, 0]) * (others @ w)
    return out


def _pattern_contributions(leaf: Leaf, codes: np.ndarray) -> np.ndarray:
    """Contributions for hit patterns given as bit codes, one row per code."""
    return _leaf_contributions(leaf, (codes[:, None] >> leaf.bits) & 1)


@dataclass
class TreeTests:
    """What one tree asks of a row: the distinct (feature, limit) tests, and its leaves."""

    features: np.ndarray
    limits: np.ndarray
    leaves: list[Leaf]


def tests_by_tree(leaves: list[Leaf]) -> list[TreeTests]:
    by_tree: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        by_tree.setdefault(leaf.tree, []).append(leaf)
    out = []
    for group in by_tree.values():
        asked = set()
        for leaf in group:
            for f, low, high in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), strict=True):
                asked |= {(f, x) for x in (low, high) if np.isfinite(x)}
        if asked:
            pairs = sorted(asked)
            out.append(TreeTests(np.array([f for f, _ in pairs]), np.array([x for _, x in pairs]), group))
    return out


def _answers(tests: TreeTests, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each different way to answer a tree's tests, and which of them each row gives."""
    small = values[:, tests.features] <= tests.limits
    words = [small[:, s : s + WORD_TESTS] @ (1 << np.arange(min(WORD_TESTS, small.shape[1] - s))) for s in range(0, small.shape[1], WORD_TESTS)]
    keys = words[0] if len(words) == 1 else np.unique(np.stack(words, axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def batch_contributions(leaves: list[Leaf], values: np.ndarray, tests: list[TreeTests] | None = None) -> np.ndarray:
    """Contribution of every feature for a batch of rows."""
    total = np.zeros(values.shape)
    for tree in tests_by_tree(leaves) if tests is None else tests:
        first, which = _answers(tree, values)
        some = values[first]  # rows that answer alike meet the same conditions of every path
        part = np.zeros(some.shape)
        for leaf in tree.leaves:
            if len(leaf.features) == 0:
                continue
            codes = _hits(leaf, some) @ (1 << leaf.bits)
            if leaf.table is not None:
                part[:, leaf.features] += leaf.table[codes]
            else:
                seen, at = np.unique(codes, return_inverse=True)
                part[:, leaf.features] += _pattern_contributions(leaf, seen)[at]
        total += part[which]
    return total


def bias_of(leaves: list[Leaf]) -> float:
    """Expected log-odds over the training cover."""
    return float(sum(leaf.value * leaf.cover.prod() for leaf in leaves))


def contributions(model: PipelineModel, frame: DataFrame, *keep: str, leaves: list[Leaf] | None = None) -> DataFrame:
    """(keep..., values, contributions, bias, log_odds) per row; bias + sum = log-odds.

    ``leaves`` can be given if they are at hand, as they do not depend on the rows.
    """
    leaves = leaves_of(model) if leaves is None else leaves
    bias, tests = bias_of(leaves), tests_by_tree(leaves)
    rows = vector_arrays(model, frame, list(keep))
    explained = with_lists(rows, "contributions", lambda batch: batch_contributions(leaves, matrix(batch), tests))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return explained.withColumns({"bias": F.lit(bias), "log_odds": F.lit(bias) + total})


def margins_per_iteration(model: PipelineModel, frame: DataFrame, *keep: str) -> DataFrame:
    """(keep..., margins): log-odds after the first, second, ... tree, as an array."""
    trees = Trees.of(boosted_stage(model))
    rows = vector_arrays(model, frame, list(keep))
    return with_lists(rows, "margins", lambda batch: margins(trees, matrix(batch), 0, len(trees.roots))).drop("values")


def gain_importance(model: PipelineModel, features: list[str] | None = None) -> DataFrame:
    """Mean gain per split of each feature, scaled to sum to one, highest first: an aggregation of the node table."""
    return gain_by_feature(node_table(boosted_stage(model)), features or list(fv.MODEL_COLUMNS))
