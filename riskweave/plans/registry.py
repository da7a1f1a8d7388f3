"""Named queries over the warehouse tables, each with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            EXPECTED_SQL[name] = sql
        return fn

    return register


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double: sums of doubles depend on the order of addition."""
    return frame.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


# The transaction table as SQL; mirrors the definition of riskweave.sources.warehouse.
TX = """
WITH facts AS (
  SELECT o_custkey, min(o_orderdate) AS first_order, count(*) AS n_orders,
         sum(CAST(floor(o_totalprice / 5.0::DOUBLE) AS BIGINT)) AS sum_cents
  FROM orders GROUP BY o_custkey
), base AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderdate, c.c_nationkey % 12 AS home, f.first_order, f.n_orders,
         CAST(f.sum_cents AS BIGINT) AS sum_cents, CAST(floor(o.o_totalprice / 5.0::DOUBLE) AS BIGINT) AS cents,
         ['US','GB','FR','DE','IT','ES','CA','AU','JP','BR','NL','TR'] AS names
  FROM orders o JOIN facts f ON o.o_custkey = f.o_custkey JOIN customer c ON o.o_custkey = c.c_custkey
), raw AS (
  SELECT k AS transaction_id, o_custkey AS user_id,
         CAST(datediff('day', first_order, o_orderdate) AS INTEGER) AS account_age_days,
         CAST(n_orders AS INTEGER) AS total_transactions_user,
         (sum_cents // n_orders) / 100.0::DOUBLE AS avg_amount_user,
         cents / 100.0::DOUBLE AS amount,
         names[home + 1] AS country,
         CASE WHEN k % 7 = 0 THEN names[(home + 1) % 12 + 1] ELSE names[home + 1] END AS bin_country,
         CASE WHEN k % 2 = 0 THEN 'web' ELSE 'app' END AS channel,
         ['electronics','fashion','grocery','gaming','travel'][k % 5 + 1] AS merchant_category,
         CAST(k % 5 = 0 AS INTEGER) AS promo_used,
         CAST(k % 11 <> 0 AS INTEGER) AS avs_match,
         CAST(k % 13 <> 0 AS INTEGER) AS cvv_result,
         CAST(k % 3 <> 0 AS INTEGER) AS three_ds_flag,
         CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE ((k * 37) % 50000) / 10.0::DOUBLE END AS shipping_distance_km,
         o_orderdate + to_seconds(k * 7919 % 86400) AS transaction_time
  FROM base
), tx AS (
  SELECT *, CAST((account_age_days <= 30 AND promo_used = 1 AND three_ds_flag = 0)
              OR (country <> bin_country AND avs_match = 0)
              OR (shipping_distance_km > 4500 AND amount > 900)
              OR transaction_id % 97 = 0 AS INTEGER) AS is_fraud
  FROM raw
), scored AS (
  SELECT transaction_id, is_fraud AS label,
         least(999, (transaction_id * 7919 % 1000) * 6 // 10 + 350 * is_fraud) / 1000.0::DOUBLE AS score
  FROM tx
)
"""


def tx(body: str) -> str:
    """SQL over ``tx`` and ``scored``; ``body`` starts with more CTEs (", name AS (...)") or with SELECT."""
    return TX + body
