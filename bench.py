"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.
Every query is run to completion without fetching its rows to the driver.
"""

from __future__ import annotations

import json
import os
import time

from riskweave.plans import catalog, data_queries, scoring_job, training_job
from riskweave.session import local_session
from riskweave.sources import warehouse
from riskweave.sources.scratch import scratch_path, spread, staged

HEADLINE = [
    "flagship_rate_by_night_and_mismatch",
    "v2_rule_check",
    "p2_top_values",
    "p3_describe",
    "p4_mutual_information",
    "p9_box_statistics",
    "p10_temporal_rates",
    "p12_category_rates",
    "f11_fitted_statistics",
    "f13_engineered_chain",
    "d1_stratified_split",
    "d4_stratified_folds",
    "t1_threshold_curve",
    "t6_all_strategies",
    "e5_evaluate_models",
    "l2_decisions_all_strategies",
    "l6_stream_accepted",
    "l7_request_log_summary",
    "x3_top_contributors",
    "x4_global_importance",
    "c5_best_gap",
    "m6_boosted_trees",
    "x1_contributions_additive",
]


def scoring_throughput(spark, sf_dir: str, seconds: dict) -> dict:
    """Rows per second of validate, engineer, predict and decide on stored requests, plain and explained.

    The model has the tuned 100 trees; its training is not timed.
    """
    raw = warehouse.transactions(spark, sf_dir)
    folder = scratch_path(spark, "bench-model")
    training_job.save_all(spark, training_job.train(raw), folder, "bench")
    ready = scoring_job.Deployed.load(spark, folder)
    requests = staged(spread(data_queries.broken_requests(spark, sf_dir)), "requests")
    n = requests.count()
    rates = {}
    for name, explain in (("score_batch_100_trees", False), ("score_batch_100_trees_explained", True)):
        start = time.perf_counter()
        accepted, _ = scoring_job.score_batch(requests, ready, include_explanation=explain)
        accepted.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(n / seconds[name], 1)
    return rates


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="riskweave-bench")
    catalog.QUERIES["p13_baseline_rate"](spark, sf_dir).collect()  # start-up, not timed
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    throughput = scoring_throughput(spark, sf_dir, seconds)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "throughput_rows_per_sec": throughput,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
