"""Vectors of any size, samples by hash, join keys that no group of entities shares, names that clash."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import bit_sliced, neural_partitions, privacy


def nearest_by_integers(rows, step, k):
    whole = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows]
    out = []
    for q, a in whole:
        if q % step == 0:
            dots = ((sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            best = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in dots)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def test_wide_vectors_are_scored_exactly(spark):
    """As queries and as candidates, just beyond the narrow bound, far beyond it, and beyond 64 bits."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 1, 4).tolist()) for i in range(120)]
    rows += [(200 + i, (r.normal(0, 1, 4) * 2.0**size).tolist()) for i, size in enumerate([16, 17, 20, 25, 31, 40, 53, 54, 60, 200, 1000])]
    rows += [(300, [65536.0, 0.0, 0.0, 0.0]), (310, [-1e30] * 4), (320, [1e300, -1e300, 1e300, 1.0]), (330, [2.0**19] * 4), (340, [2.0**19 + 0.25] * 4)]
    rows += [(400, [1e9, 2.0]), (410, [0.5, 0.25]), (420, [1e9, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, bit_sliced.top_k(frame, F.col("vec_id") % 10 == 0, 6).collect()))
    assert got == nearest_by_integers(rows, 10, 6)


def test_only_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "WIDE_BLOCK", 7)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(0, 1, 3) * 1e12).tolist()) for i in range(60)] + [(100 + i, [3e12, 1e12, 2e12]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, bit_sliced.top_k(frame, F.col("vec_id") % 10 == 0, 10).collect())) == nearest_by_integers(rows, 10, 10)


def test_partitions_fitted_on_part_of_the_rows(spark, monkeypatch):
    """A sample smaller than the table, a third of it copies of one vector; recall against brute force."""
    monkeypatch.setattr(neural_partitions, "SAMPLE", 640)
    monkeypatch.setattr(neural_partitions, "PARTS", 4)
    monkeypatch.setattr(neural_partitions, "BLOCK", 500)
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (20, 16))
    x = np.vstack([np.repeat(centres, 150, axis=0) + r.normal(0, 0.3, (3000, 16)), np.tile(centres[:1], (1500, 1))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for row in neural_partitions.nearest(frame, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(row.query_id, []).append(row.score)
    hits = total = 0
    for q in range(0, len(x), 20):
        s = np.delete(x @ x[q], q)
        fifth = np.sort(s)[-5]
        hits += sum(v >= fifth - 1e-9 for v in got[q])
        total += 5
    assert hits / total >= 0.9


def test_entities_of_one_document_share_no_join_key(spark):
    rows = [(i, f"mail user{i}@host{i}.org about code{i}") for i in range(40)] + [(100 + i, "mail about nothing") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms, _ = privacy.disclosing(docs, "text", privacy.THRESHOLD, privacy.SUPPORT)
    assert {r.value for r in terms.collect()} == {f"code{i}" for i in range(40)}
    alone, _ = privacy.disclosing(docs.limit(1), "text", privacy.THRESHOLD, privacy.SUPPORT)
    assert alone.count() == 0
