"""Rows walk down one tree after the other; leaves are those of a walk of all trees at once, missing values go right."""

from __future__ import annotations

import numpy as np

from riskweave.operators import tree_models


def forest(trees=7, depth=5, seed=1):
    """Random trees of unequal depth; children come after their parent."""
    made = np.random.default_rng(seed)
    roots, feature, threshold, left, right, level = [], [], [], [], [], []
    for t in range(trees):
        roots.append(len(left))
        waiting = [0]
        for d in waiting:
            i = len(left)
            inner = d < min(depth, t) and made.random() < 0.8
            feature.append(int(made.integers(0, 3)) if inner else 0)
            threshold.append(made.normal() if inner else np.inf)
            first = roots[-1] + len(waiting)
            left.append(first if inner else i)
            right.append(first + 1 if inner else i)
            level.append(d)
            waiting += [d + 1, d + 1] if inner else []
    arrays = [np.array(x) for x in (roots, feature, threshold, left, right, level)]
    size = len(left)
    return tree_models.Trees(*arrays, np.arange(size, dtype=float), np.zeros(size), np.ones(size), arrays[3] == np.arange(size))


def test_leaves_are_those_of_a_walk_of_all_trees_at_once(monkeypatch):
    trees = forest()
    values = np.random.default_rng(2).normal(size=(101, 3))
    values[::10, 1] = np.nan
    at = np.tile(trees.roots, (len(values), 1))
    for _ in range(trees.deepest):
        small = np.take_along_axis(values, trees.feature[at], axis=1) <= trees.threshold[at]
        at = np.where(small, trees.left[at], trees.right[at])
    assert len(set(trees.steps)) > 2 and len(trees.steps) == 7
    monkeypatch.setattr(tree_models, "ROWS_AT_ONCE", 40)
    assert np.array_equal(trees.reached(values), at)
    assert np.array_equal(trees.reached(values, 2, 5), at[:, 2:5])
