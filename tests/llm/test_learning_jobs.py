"""Learning tasks of op4 run side by side: a fit is one job, however many tasks it has."""

from __future__ import annotations

import numpy as np

from riskweave.llm import context_mixing, token_mixing


def jobs_of(spark, group, made):
    spark.sparkContext.setJobGroup(group, group)
    try:
        made()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_weights_of_tokens_are_learned_by_all_tasks_at_once(spark):
    heads = token_mixing.heads_of(np.r_[1.0, np.zeros(15), 5.0, np.zeros(239)])
    body = token_mixing.packed_codes(np.array([1 << 1 | 1, -1, 1 << 1 | 1]))
    few, many = (spark.createDataFrame([(body,)] * 12, "codes binary").repartition(n) for n in (2, 6))
    counts = [jobs_of(spark, f"tokens-{n}", lambda d=d: token_mixing.fitted(d, 36, heads)) for n, d in ((2, few), (6, many))]
    assert counts[0] == counts[1]


def test_weights_of_letters_are_learned_by_all_tasks_at_once(spark):
    words = [(f"word{i}".encode(),) for i in range(60)]
    few, many = (spark.createDataFrame(words, "token binary").repartition(n) for n in (2, 6))
    counts = [jobs_of(spark, f"letters-{n}", lambda d=d: context_mixing.fitted(d)) for n, d in ((2, few), (6, many))]
    assert counts[0] == counts[1]


def test_counts_by_class_are_those_of_the_words(spark, monkeypatch):
    """Counts are added up a batch at a time and start anew with each bucket."""
    monkeypatch.setattr(context_mixing, "BUCKET_BYTES", 40)
    texts = ["the the cat", None, "", "the dog ox ox", "a a the cat", "cat"] * 7
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = context_mixing.coded(docs, "doc_id", "text", 5, 1)
    held = {r["key"] for r in rows.filter("held_out").collect()}
    want, got = {}, {}
    for i, t in enumerate(texts):
        tokens = context_mixing.tokens_of(t)
        for x in tokens if i not in held else []:
            k = (x, context_mixing.class_of(tokens))
            want[k] = want.get(k, 0) + 1
    for r in rows.filter("token IS NOT NULL").collect():
        for c in range(context_mixing.CLASSES):
            if r[f"c{c}"]:
                got[bytes(r["token"]), c] = got.get((bytes(r["token"]), c), 0) + r[f"c{c}"]
    assert got == want and rows.select("bucket").distinct().count() > 3
