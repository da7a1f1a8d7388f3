"""Steps that a job must not take twice, and batches that fill the cores."""

from __future__ import annotations

from types import SimpleNamespace

from riskweave.plans import model_queries, training_job
from riskweave.streaming import online


def test_a_stored_model_is_tried_on_the_rows_that_the_job_has_split(spark, sf_dir, monkeypatch):
    """The rows are split once; the split of the job is read again for the reloaded pipeline."""
    from riskweave.operators import splits

    made, place = [], splits.ranked_blocks

    def seen(*args, **kwargs):
        made.append(1)
        return place(*args, **kwargs)

    monkeypatch.setattr(splits, "ranked_blocks", seen)
    row = model_queries.sc7(spark, sf_dir).first()
    assert row["n_rows"] == row["n_equal"] > 0
    assert len(made) == 1


def test_a_job_keeps_its_split_rows(transactions):
    placed = training_job.split_rows(transactions)
    assert set(transactions.columns) | {"split"} == set(placed.columns)
    assert placed.count() == transactions.count()


def test_a_batch_of_the_stream_has_a_file_for_each_core():
    with_cores = lambda n: SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=n))
    assert [online.files_at_once(with_cores(n)) for n in (1, 4, 12, 96)] == [4, 4, 12, 96]
