"""Rounds that are followed where their trees grow: the numbers of the distributed way, and no job for a round."""

from __future__ import annotations

import numpy as np
import pytest

from riskweave.operators import boosting, search
from riskweave.plans import training_job

PARAMS = {"max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "min_child_weight": 3}


@pytest.fixture(scope="module")
def data(transactions):
    return training_job.prepared(transactions)[0].filter("split <> 'test'")


def test_rounds_are_those_of_the_distributed_way(data, monkeypatch):
    """Without draws, as these follow the order in which the rows of a call were stored."""
    params = {**PARAMS, "subsample": 1.0}
    here = [tuple(r) for r in search.iteration_tracking(data, params, rounds=6, folds=2).collect()]
    monkeypatch.setattr(boosting, "HELD_OF_MANY", 0)
    apart = [tuple(r) for r in search.iteration_tracking(data, params, rounds=6, folds=2).collect()]
    assert len(here) == 6 and np.allclose(here, apart, rtol=0, atol=1e-9)


def test_rounds_need_no_jobs_of_their_own(spark, data, monkeypatch):
    """More rounds than one evaluation job covers."""
    monkeypatch.setattr(search, "ROUNDS_PER_JOB", 2)

    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        search.iteration_tracking(data, PARAMS, rounds=rounds, folds=2).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(7)


def test_average_precision_counts_rows_of_one_score_together():
    score, label = np.array([0.9, 0.9, 0.5, 0.5, 0.5, 0.1]), np.array([1, 0, 1, 1, 0, 0])
    assert boosting.average_precision(score, label) == pytest.approx((1 / 2 + 2 * 3 / 5) / 3)
    assert boosting.average_precision(score, 0 * label) is None
    assert boosting.average_precision(score, 0 * label + 1) == 1.0
