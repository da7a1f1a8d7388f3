"""Summary of a request log: latency statistics, success rate and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.quantiles import exact_percentiles


def latency_summary(
    log: DataFrame,
    latency: str = "value",
    failed: str = "event_type = 'error'",
    time: str = "ts",
) -> DataFrame:
    """One row: counts, mean, median, p95, p99, min, max of successful requests, success rate, throughput.

    p95 and p99 take the value at sorted index ``int(n * p / 100)``, at most the last one.
    """
    ok = log.filter(~F.expr(failed))
    good = F.when(~F.expr(failed), F.col(latency))
    totals = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~F.expr(failed)).alias("successful_requests"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        F.avg(good).alias("mean"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
    )
    n = ok.agg(F.count(latency).alias("n")).first()["n"]
    values: dict[str, float | None] = {"median": None, "p95": None, "p99": None}
    if n:
        # the indexed value is an exact percentile at a position without interpolation
        places = {p: min(n * p // 100, n - 1) / (n - 1) if n > 1 else 0.0 for p in (95, 99)}
        found = {t.share: t.low for t in exact_percentiles(ok, [latency], [0.5, *places.values()])}
        values = {"median": found[0.5], "p95": found[places[95]], "p99": found[places[99]]}
    seconds = F.timestamp_diff("MICROSECOND", F.col("first_at"), F.col("last_at")) / F.lit(1e6)
    return totals.select(
        "total_requests",
        "successful_requests",
        F.round(F.col("successful_requests") / F.col("total_requests") * 100, 2).alias("success_rate"),
        F.col("mean").alias("mean_ms"),
        *[F.lit(v).cast("double").alias(f"{k}_ms") for k, v in values.items()],
        F.col("min").alias("min_ms"),
        F.col("max").alias("max_ms"),
        F.when(seconds > 0, F.col("successful_requests") / seconds).alias("throughput_rps"),
    )
