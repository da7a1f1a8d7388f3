"""Distributed percentiles, running totals, splits and curves against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import curves, list_metrics, metrics, splits, thresholds
from riskweave.operators.quantiles import exact_percentiles
from riskweave.operators.running import running_totals


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("shape", ["distinct", "hot", "constant", "single"])
def test_percentiles_match_numpy(spark, shape, small):
    rng = random.Random(5)
    values = {
        "distinct": [rng.random() * 1000 for _ in range(3001)],
        # one value holds a third of all rows
        "hot": [7.0] * 1000 + [float(rng.randint(0, 50)) for _ in range(2000)],
        "constant": [3.0] * 50,
        "single": [4.5],
    }[shape]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    found = {t.share: t.low for t in exact_percentiles(frame, ["v"], shares, small=small)}
    for s in shares:
        assert found[s] == pytest.approx(np.quantile(values, s), abs=1e-9)


@pytest.mark.parametrize("small", [0, 10**6])
def test_percentiles_by_group(spark, small):
    rows = [(i % 3, float(i * i % 997)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g int, v double")
    found = {(t.group, t.share): t.low for t in exact_percentiles(frame, ["v"], [0.25, 0.9], by="g", small=small)}
    for g in range(3):
        values = [v for k, v in rows if k == g]
        for s in (0.25, 0.9):
            assert found[(g, s)] == pytest.approx(np.quantile(values, s))


def test_percentiles_of_no_rows(spark):
    assert exact_percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]) == []


@pytest.mark.parametrize("rows_per_range", [3, 17, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, rows_per_range, descending):
    rng = random.Random(2)
    rows = [(g, float(x), rng.randint(0, 9)) for g in ("a", "b") for x in rng.sample(range(500), 60)]
    frame = spark.createDataFrame(rows, "g string, x double, n int")
    got = running_totals(frame, "x", ["n"], ["g"], descending, following=["n"], rows_per_range=rows_per_range).collect()
    assert len(got) == len(rows)
    by_key = {(r["g"], r["x"]): r for r in got}
    for g in ("a", "b"):
        ordered = sorted([r for r in rows if r[0] == g], key=lambda r: r[1], reverse=descending)
        total = 0
        for i, (_, x, n) in enumerate(ordered):
            total += n
            row = by_key[(g, x)]
            assert row["cum_n"] == total
            assert row["all_n"] == sum(r[2] for r in ordered)
            assert row["next_n"] == (ordered[i + 1][2] if i + 1 < len(ordered) else None)


def brute_split(ids_by_class, seed):
    """The split by global hash ranks."""
    n = sum(map(len, ids_by_class.values()))
    out = {}
    n_test = -(-n // 5)
    exact = {c: len(v) * n_test / n for c, v in ids_by_class.items()}
    take = {c: int(e) for c, e in exact.items()}
    for c in sorted(exact, key=lambda c: (-(exact[c] - take[c]), c))[: n_test - sum(take.values())]:
        take[c] += 1
    for c, ids in ids_by_class.items():
        ranked = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        for r, i in enumerate(ranked):
            out[i] = "test" if r < take[c] else "rest"
    return out


@pytest.mark.parametrize("fetch_limit", [2, 10_000])
def test_split_matches_global_ranks(spark, monkeypatch, fetch_limit):
    monkeypatch.setattr(splits, "FETCH_LIMIT", fetch_limit)  # a low limit forces narrowing passes
    monkeypatch.setattr(splits, "PREFIX_STEP", 1 if fetch_limit == 2 else 3)
    rows = [(i, int(i % 23 == 0)) for i in range(1237)]
    frame = spark.createDataFrame(rows, "transaction_id long, is_fraud int")
    got = {r["transaction_id"]: r["split"] for r in splits.train_val_test(frame, seed=3).collect()}
    want = brute_split({"0": [i for i, y in rows if not y], "1": [i for i, y in rows if y]}, 3)
    assert {i: s == "test" for i, s in got.items()} == {i: s == "test" for i, s in want.items()}
    sizes = {s: sum(v == s for v in got.values()) for s in set(got.values())}
    assert sizes == {"test": 248, "validation": 248, "train": 741}


def test_split_is_stable_and_seeded(spark):
    frame = spark.range(500).select(F.col("id").alias("transaction_id"), (F.col("id") % 20 == 0).cast("int").alias("is_fraud"))
    a, b = splits.train_val_test(frame), splits.train_val_test(frame.repartition(7))
    assert a.exceptAll(b).isEmpty()
    assert not a.exceptAll(splits.train_val_test(frame, seed=2)).isEmpty()


def test_split_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum"):
        splits.train_val_test(spark.range(10), None, 0.5, 0.2, 0.2, keys=["id"])


def test_folds_are_even(spark):
    frame = spark.range(1003).select(F.col("id").alias("transaction_id"), (F.col("id") % 31 == 0).cast("int").alias("is_fraud"))
    rows = splits.stratified_folds(frame, folds=4).groupBy("fold").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("p")).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3]
    for column in ("n", "p"):
        values = [r[column] for r in rows]
        assert max(values) - min(values) <= 1


def test_weights(spark):
    frame = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_fraud int")
    assert {r["weight"] for r in splits.class_weights(frame).filter("is_fraud = 1").collect()} == {3.0}
    balanced = splits.class_weights(frame, scheme="balanced").groupBy("is_fraud").agg(F.sum("weight").alias("w")).collect()
    assert {r["w"] for r in balanced} == {2.0}
    with pytest.raises(ValueError):
        splits.class_weights(frame.filter("is_fraud = 0"))


def scored_frame(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def brute_curve(pairs):
    positives = sum(y for y, _ in pairs)
    points = []
    for s in sorted({p for _, p in pairs}):
        tp = sum(y for y, p in pairs if p >= s)
        fp = sum(1 - y for y, p in pairs if p >= s)
        points.append((s, tp, fp, tp / (tp + fp), tp / positives))
    return points


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    out = []
    for _ in range(1000):
        y = int(rng.random() < 0.1)
        out.append((y, round(rng.betavariate(5, 2) if y else rng.betavariate(2, 5), 2)))
    return out


@pytest.mark.parametrize("rows_per_range", [7, 10**6])
def test_curve_matches_brute_force(spark, pairs, rows_per_range):
    counts = curves.score_counts(scored_frame(spark, pairs))
    got = curves.threshold_curve(counts, rows_per_range=rows_per_range).orderBy("threshold").collect()
    want = brute_curve(pairs)
    assert [(r["threshold"], r["tp"], r["fp"]) for r in got] == [w[:3] for w in want]
    assert [r["precision"] for r in got] == pytest.approx([w[3] for w in want])
    assert [r["recall"] for r in got] == pytest.approx([w[4] for w in want])
    assert [r["position"] for r in got] == list(range(len(want)))


def test_average_precision_is_a_step_sum(spark):
    scored = scored_frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    row = metrics.evaluate(scored).first()
    assert row["pr_auc"] == pytest.approx(0.8333333333)
    assert row["roc_auc"] == pytest.approx(0.75)


def test_roc_auc_equals_pair_count(spark, pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert metrics.evaluate(scored_frame(spark, pairs)).first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_metrics_without_positives_or_hits(spark):
    row = metrics.evaluate(scored_frame(spark, [(0, 0.1), (0, 0.4)])).first()
    assert row["pr_auc"] is None and row["roc_auc"] is None
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_thinned_roc_keeps_the_area(spark, pairs):
    full = curves.roc_points(scored_frame(spark, pairs)).orderBy("fpr", "tpr").collect()
    thin = curves.roc_points(scored_frame(spark, pairs), drop_collinear=True).orderBy("fpr", "tpr").collect()
    area = lambda pts: sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(pts, pts[1:]))
    assert area(thin) == pytest.approx(area(full))
    assert len(thin) <= len(full)


def test_strategies_meet_their_targets(spark, pairs):
    curve = curves.curve_of(scored_frame(spark, pairs)).persist()
    rows = {r["strategy"]: r for r in thresholds.all_strategies(curve).collect()}
    points = brute_curve(pairs)
    for name, target in (("conservative_90pct_recall", 0.9), ("balanced_85pct_recall", 0.85)):
        allowed = [p for p in points if p[4] >= target]
        assert rows[name]["recall"] >= target
        assert rows[name]["precision"] == pytest.approx(max(p[3] for p in allowed))
    f1 = [2 * p[3] * p[4] / (p[3] + p[4] + 1e-10) for p in points]
    assert rows["optimal_f1"]["f1"] == pytest.approx(max(f1))
    assert rows["optimal_f1"]["threshold"] == points[f1.index(max(f1))][0]
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(pairs) for r in rows.values())


def test_impossible_targets_leave_no_row(spark, pairs):
    curve = curves.curve_of(scored_frame(spark, pairs))
    assert thresholds.recall_thresholds(curve, {"impossible": 1.1}).count() == 0
    assert thresholds.precision_threshold(curve, 1.01).count() == 0


def test_missing_target_keeps_names_and_recommendation(spark, pairs):
    curve = curves.curve_of(scored_frame(spark, pairs))
    found = thresholds.all_strategies(curve, {"impossible": 1.1, "half": 0.5}, min_precision=1.01)
    rows = thresholds.strategy_artifact(found).collect()
    assert [r["strategy"] for r in rows] == ["optimal_f1", "half"]
    assert [r["recommended"] for r in rows] == [1, 0]
    names = [r["strategy"] for r in thresholds.comparison_table(found).collect()]
    assert names == ["Optimal F1 (Best Balance)", "50% Recall"]


@pytest.mark.parametrize("rows_per_range", [40, 10_000])
def test_metrics_of_score_lists_equal_separate_ones(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(list_metrics, "HELD_SCORES", 300)
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((400, 3)), 2)  # many ties
    scores[:, 2] = 0.25
    rows = [(("a", "b")[i % 2], int(rng.random() < s[0]), s.tolist()) for i, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "split string, label int, scores array<double>").repartition(3)
    each = frame.selectExpr("split", "label", "posexplode(scores) AS (place, score)")
    key = lambda r: (r["place"], r["split"])
    want = {key(r): r.asDict() for r in metrics.evaluate(each, ["place", "split"]).collect()}
    got = {key(r): r.asDict() for r in list_metrics.list_metrics(frame, 3, 400, "label", rows_per_range=rows_per_range).collect()}
    assert set(got) == set(want) and len(want) == 6
    for k, r in want.items():
        assert got[k] == pytest.approx(r, abs=1e-12)
