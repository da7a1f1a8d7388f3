"""Queries: sources, validation, profiling and dataset preparation."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.temporal import TIME_FORMAT
from riskweave.operators import profiling, splits, validation
from riskweave.operators.features import FittedStatistics, engineered
from riskweave.plans.registry import query, rounded, tx
from riskweave.sources import files, warehouse
from riskweave.sources.scratch import scratch_path, staged

NUM = fv.RAW_NUMERIC
CAT = fv.RAW_CATEGORICAL


def unpivot_sql(columns: list[str], source: str = "tx", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value{extra} FROM {source}" for c in columns
    )


def number_sql(columns: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v{extra} FROM tx" for c in columns)


# ---- sources -------------------------------------------------------------------


@query(
    "sc1_csv_transactions",
    tx("""SELECT count(*) AS n_rows, round(avg(is_fraud), 6) AS positive_rate FROM tx"""),
)
def sc1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "transactions-csv")
    files.write_csv(warehouse.transactions(spark, sf), path)
    return rounded(files.transaction_report(files.read_transactions_csv(spark, path)))


@query("sc2_csv_shape", "SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM orders")
def sc2(spark: SparkSession, sf: str) -> DataFrame:
    orders = warehouse.table(spark, sf, "orders")
    path = scratch_path(spark, "orders-csv")
    files.write_csv(orders, path)
    return files.shape_report(files.read_csv(spark, path, orders.schema))


# ---- validation ----------------------------------------------------------------

BROKEN = """, broken AS (
  SELECT transaction_id, user_id, account_age_days, total_transactions_user, avg_amount_user,
         CASE WHEN transaction_id % 50 = 1 THEN -amount - 1 ELSE amount END AS amount,
         CASE WHEN transaction_id % 50 = 2 THEN country || 'X' ELSE lower(country) END AS country,
         bin_country,
         CASE WHEN transaction_id % 50 = 3 THEN 'kiosk' ELSE channel END AS channel,
         CASE WHEN transaction_id % 50 = 6 THEN NULL ELSE merchant_category END AS merchant_category,
         CASE WHEN transaction_id % 50 = 5 THEN 2 ELSE promo_used END AS promo_used,
         avs_match, cvv_result, three_ds_flag, shipping_distance_km,
         CASE WHEN transaction_id % 50 = 4 THEN 'yesterday' WHEN transaction_id % 50 = 7 THEN '2024-13-40 10:00:00'
              ELSE strftime(transaction_time, '%Y-%m-%d %H:%M:%S') END AS transaction_time
  FROM tx)
"""


def broken_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions as text-time requests, with one in seven of every fifty broken in a different way."""
    k = F.col("transaction_id") % 50
    return (
        warehouse.transactions(spark, sf)
        .withColumns(
            {
                "amount": F.when(k == 1, -F.col("amount") - 1).otherwise(F.col("amount")),
                "country": F.when(k == 2, F.concat("country", F.lit("X"))).otherwise(F.lower("country")),
                "channel": F.when(k == 3, "kiosk").otherwise(F.col("channel")),
                "merchant_category": F.when(k != 6, F.col("merchant_category")),
                "promo_used": F.when(k == 5, 2).otherwise(F.col("promo_used")),
                "transaction_time": F.when(k == 4, "yesterday")
                .when(k == 7, "2024-13-40 10:00:00")
                .otherwise(F.date_format("transaction_time", TIME_FORMAT)),
            }
        )
        .drop("is_fraud")
    )


@query(
    "v1_parse_utc_time",
    tx(
        BROKEN
        + """SELECT transaction_id, try_strptime(transaction_time, '%Y-%m-%d %H:%M:%S') AS transaction_time FROM broken"""
    ),
)
def v1(spark, sf):
    return validation.with_utc_time(broken_requests(spark, sf)).select("transaction_id", "transaction_time")


@query(
    "v2_rule_check",
    tx(
        BROKEN
        + """, checked AS (SELECT transaction_id, concat_ws(',',
      CASE WHEN amount < 0 THEN 'amount:negative' END,
      CASE WHEN length(country) <> 2 THEN 'country:not_two_letters' END,
      CASE WHEN channel NOT IN ('web', 'app') THEN 'channel:unknown' END,
      CASE WHEN merchant_category IS NULL THEN 'merchant_category:required' END,
      CASE WHEN promo_used NOT IN (0, 1) THEN 'promo_used:not_flag' END,
      CASE WHEN NOT regexp_full_match(transaction_time, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}')
           THEN 'transaction_time:format' END) AS errors FROM broken)
    SELECT errors, count(*) AS n FROM checked GROUP BY errors"""
    ),
)
def v2(spark, sf):
    checked = validation.checked(broken_requests(spark, sf))
    return checked.groupBy(F.concat_ws(",", "errors").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "v2_quarantine_split",
    tx(
        BROKEN
        + """SELECT CASE WHEN transaction_id % 50 BETWEEN 1 AND 6 THEN 'rejected' ELSE 'valid' END AS part,
    count(*) AS n FROM broken GROUP BY 1"""
    ),
)
def v2_split(spark, sf):
    checked = validation.checked(broken_requests(spark, sf))
    good = validation.valid_rows(checked).select(F.lit("valid").alias("part"))
    bad = validation.rejected_rows(checked).select(F.lit("rejected").alias("part"))
    return good.unionByName(bad).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v3_grain_check",
    tx("""SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT transaction_id, user_id FROM tx)) AS n_keys,
    CAST(count(*) = (SELECT count(*) FROM (SELECT DISTINCT transaction_id, user_id FROM tx)) AS INTEGER) AS is_unique
    FROM tx"""),
)
def v3(spark, sf):
    return validation.grain_check(warehouse.transactions(spark, sf))


AUDIT_TYPES = [
    ("transaction_id", "bigint"),
    ("user_id", "bigint"),
    ("account_age_days", "int"),
    ("total_transactions_user", "int"),
    ("avg_amount_user", "double"),
    ("amount", "double"),
    ("country", "string"),
    ("bin_country", "string"),
    ("channel", "string"),
    ("merchant_category", "string"),
    ("promo_used", "int"),
    ("avs_match", "int"),
    ("cvv_result", "int"),
    ("three_ds_flag", "int"),
    ("shipping_distance_km", "double"),
    ("transaction_time", "timestamp_ntz"),
]


@query(
    "v4_column_audit",
    tx(
        BROKEN
        + """, parsed AS (SELECT * REPLACE (try_strptime(transaction_time, '%Y-%m-%d %H:%M:%S') AS transaction_time)
        FROM broken) """
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS n_filled, "
            f"count(*) - count({c}) AS n_null FROM parsed"
            for c, t in AUDIT_TYPES
        )
    ),
)
def v4(spark, sf):
    return validation.column_audit(validation.with_utc_time(broken_requests(spark, sf)))


@query(
    "v5_upper_countries",
    tx(
        BROKEN
        + """SELECT upper(country) AS country, upper(bin_country) AS bin_country, count(*) AS n
    FROM broken GROUP BY 1, 2"""
    ),
)
def v5(spark, sf):
    upper = validation.with_upper_countries(broken_requests(spark, sf))
    return upper.groupBy("country", "bin_country").agg(F.count(F.lit(1)).alias("n"))


# ---- profiling -----------------------------------------------------------------


@query(
    "p1_class_distribution",
    tx("""SELECT is_fraud AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM tx)::DOUBLE, 6) AS share,
    (SELECT round(max(s) / min(s), 6) FROM (SELECT count(*) / (SELECT count(*) FROM tx)::DOUBLE AS s FROM tx GROUP BY is_fraud))
      AS imbalance_ratio,
    (SELECT CAST(max(s) / min(s) > 10 AS INTEGER) FROM (SELECT count(*)::DOUBLE AS s FROM tx GROUP BY is_fraud))
      AS is_imbalanced
    FROM tx GROUP BY is_fraud"""),
)
def p1(spark, sf):
    return rounded(profiling.class_distribution(warehouse.transactions(spark, sf)))


@query(
    "p2_top_values",
    tx(
        f""", u AS ({unpivot_sql(CAT + ["user_id"])}),
    c AS (SELECT feature, value, count(*) AS n FROM u GROUP BY 1, 2)
    SELECT feature, n_distinct, rank, value, n FROM (
      SELECT feature, value, n, count(*) OVER (PARTITION BY feature) AS n_distinct,
             CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS rank FROM c)
    WHERE rank <= 5"""
    ),
)
def p2(spark, sf):
    return profiling.top_values(warehouse.transactions(spark, sf), [*CAT, "user_id"])


@query(
    "p3_describe",
    tx(
        f""", u AS ({number_sql(NUM)})
    SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
      round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM u GROUP BY feature"""
    ),
)
def p3(spark, sf):
    return rounded(profiling.describe(warehouse.transactions(spark, sf), NUM))


MI = f""", u AS ({unpivot_sql(CAT, extra=", is_fraud AS y")}),
    cells AS (SELECT feature, value, y, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2, 3),
    m AS (SELECT *, sum(n) OVER (PARTITION BY feature, value) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
                 sum(n) OVER (PARTITION BY feature) AS total FROM cells),
    mi AS (SELECT feature, greatest(0.0, sum(n / total * ln(n * total / (nx * ny)))) AS mi_score FROM m GROUP BY feature)
"""


@query("p4_mutual_information", tx(MI + "SELECT feature, round(mi_score, 6) AS mi_score FROM mi"))
def p4(spark, sf):
    return rounded(profiling.mutual_information(warehouse.transactions(spark, sf), CAT))


@query(
    "p5_label_correlations",
    tx(
        f""", u AS ({number_sql(NUM + ["0 * amount"], extra=", is_fraud AS y")})
    SELECT CASE WHEN feature = '0 * amount' THEN 'constant' ELSE feature END AS feature,
      CASE WHEN min(v) = max(v) THEN NULL ELSE round(corr(v, y), 6) END AS correlation FROM u GROUP BY feature"""
    ),
)
def p5(spark, sf):
    frame = warehouse.transactions(spark, sf).withColumn("constant", F.lit(0.0))
    return rounded(profiling.label_correlations(frame, [*NUM, "constant"]))


@query(
    "p6_gram_matrix",
    tx(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
            f"round(sum({a}::DOUBLE * {b}::DOUBLE) / count(*), 4) AS value FROM tx"
            for i, a in enumerate(NUM)
            for b in NUM[i:]
        )
    ),
)
def p6_gram(spark, sf):
    frame = warehouse.transactions(spark, sf)
    rows = frame.agg(F.count(F.lit(1))).scalar()
    gram = profiling.gram_matrix(frame, NUM)
    return gram.select("feature_a", "feature_b", F.round(F.col("value") / rows, 4).alias("value"))


def determinant_sql(size: list[int]) -> str:
    """Determinant of the scaled Gram matrix over the given rows and columns, by permutations."""
    terms = []
    for order in itertools.permutations(range(len(size))):
        swaps = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))
        cells = [(size[i], size[j]) for i, j in enumerate(order) if size[i] != size[j]]
        factors = [f"r{min(c)}{max(c)}" for c in cells] or ["1.0::DOUBLE"]
        terms.append(("-" if swaps % 2 else "+") + "*".join(factors))
    return "(" + "".join(terms) + ")"


# VIF_i = det(scaled Gram without i) / det(scaled Gram)
VIF = (
    ", gram AS (SELECT "
    + ", ".join(
        f"sum({a}::DOUBLE * {b}) / sqrt(sum({a}::DOUBLE * {a}) * sum({b}::DOUBLE * {b})) AS r{i}{j}"
        for i, a in enumerate(NUM)
        for j, b in enumerate(NUM)
        if i < j
    )
    + " FROM tx), vif AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {determinant_sql([j for j in range(len(NUM)) if j != i])} / "
        f"{determinant_sql(list(range(len(NUM))))} AS vif FROM gram"
        for i, c in enumerate(NUM)
    )
    + ")\n"
)


@query("p6_inflation_factors", tx(VIF + "SELECT feature, round(vif, 6) AS vif FROM vif"))
def p6(spark, sf):
    return rounded(profiling.inflation_factors(warehouse.transactions(spark, sf), NUM))


@query(
    "p7_inflation_bands",
    tx(
        VIF
        + """SELECT feature, round(vif, 6) AS vif,
    CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS band FROM vif"""
    ),
)
def p7(spark, sf):
    factors = profiling.inflation_factors(warehouse.transactions(spark, sf), NUM)
    return rounded(profiling.inflation_bands(factors))


@query(
    "p8_histogram",
    tx(
        f""", u AS ({number_sql(NUM)}),
    e AS (SELECT feature, min(v) AS lo, (max(v) - min(v)) / 50.0::DOUBLE AS w, round(avg(v), 6) AS mean,
                 round(quantile_cont(v, 0.5), 6) AS median FROM u GROUP BY feature),
    b AS (SELECT u.feature, CAST(least(floor((v - lo) / w), 49) AS INTEGER) AS bin, lo, w, mean, median
          FROM u JOIN e ON u.feature = e.feature)
    SELECT feature, bin, round(any_value(lo) + any_value(w) * bin, 6) AS bin_start, count(*) AS n,
           any_value(mean) AS mean, any_value(median) AS median FROM b GROUP BY feature, bin"""
    ),
)
def p8(spark, sf):
    return rounded(profiling.histogram(warehouse.transactions(spark, sf), NUM))


@query(
    "p9_box_statistics",
    tx(
        f""", u AS ({number_sql(NUM, extra=", is_fraud AS label")}),
    q AS (SELECT feature, label, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.75) AS q3 FROM u GROUP BY feature, label),
    f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM q)
    SELECT f.feature, f.label, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3, min(CASE WHEN v BETWEEN lo AND hi THEN v END) AS whisker_low,
      max(CASE WHEN v BETWEEN lo AND hi THEN v END) AS whisker_high,
      count(CASE WHEN v NOT BETWEEN lo AND hi THEN 1 END) AS n_outliers
    FROM u JOIN f ON u.feature = f.feature AND u.label = f.label GROUP BY f.feature, f.label"""
    ),
)
def p9(spark, sf):
    return rounded(profiling.box_statistics(warehouse.transactions(spark, sf), NUM))


TEMPORAL = """, parts AS (SELECT hour(transaction_time) AS h, isodow(transaction_time) - 1 AS d,
    month(transaction_time) AS m, CAST(isodow(transaction_time) >= 6 AS INTEGER) AS w, is_fraud FROM tx),
  rates AS (
    SELECT CASE WHEN grouping(h) = 0 THEN 'hour' WHEN grouping(d) = 0 THEN 'day_of_week'
                WHEN grouping(m) = 0 THEN 'month' ELSE 'is_weekend' END AS dimension,
           CAST(coalesce(h, d, m, w) AS INTEGER) AS bucket, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives,
           sum(is_fraud)::DOUBLE / count(*) AS rate
    FROM parts GROUP BY GROUPING SETS ((h), (d), (m), (w)))
"""


@query(
    "p10_temporal_rates",
    tx(TEMPORAL + "SELECT dimension, bucket, n, positives, round(rate, 6) AS rate FROM rates"),
)
def p10(spark, sf):
    return rounded(profiling.temporal_rates(warehouse.transactions(spark, sf)))


@query(
    "p11_hour_extremes",
    tx(
        TEMPORAL
        + """SELECT
    (SELECT bucket FROM rates WHERE dimension = 'hour' ORDER BY rate DESC, bucket LIMIT 1) AS peak_hour,
    (SELECT round(max(rate), 6) FROM rates WHERE dimension = 'hour') AS peak_rate,
    (SELECT bucket FROM rates WHERE dimension = 'hour' ORDER BY rate, bucket LIMIT 1) AS safest_hour,
    (SELECT round(min(rate), 6) FROM rates WHERE dimension = 'hour') AS safest_rate"""
    ),
)
def p11(spark, sf):
    return rounded(profiling.hour_extremes(profiling.temporal_rates(warehouse.transactions(spark, sf))))


@query(
    "p11_risky_hours",
    tx(
        TEMPORAL
        + """SELECT bucket AS hour, round(rate, 6) AS rate, round(rate / b, 6) AS times_baseline
    FROM rates, (SELECT sum(is_fraud)::DOUBLE / count(*) AS b FROM tx)
    WHERE dimension = 'hour' AND rate > b * 1.2::DOUBLE"""
    ),
)
def p11_risky(spark, sf):
    rates = staged(profiling.temporal_rates(warehouse.transactions(spark, sf)), "temporal-rates")
    hours = rates.filter("dimension = 'hour'")
    base = hours.agg(F.sum("positives") / F.sum("n")).first()[0]
    return rounded(profiling.risky_hours(hours, base))


@query(
    "p12_category_rates",
    tx(
        f""", u AS ({unpivot_sql(CAT, extra=", is_fraud AS y")}),
    c AS (SELECT feature, value, CAST(sum(y) AS BIGINT) AS target_count, count(*) AS total_count,
                 sum(y)::DOUBLE / count(*) * 100 AS rate FROM u GROUP BY 1, 2)
    SELECT feature, value, target_count, total_count, round(rate, 6) AS target_rate,
           CAST(rate > (SELECT avg(is_fraud) FROM tx) * 100 * 1.5::DOUBLE AS INTEGER) AS is_high_risk FROM c"""
    ),
)
def p12(spark, sf):
    return rounded(profiling.category_rates(warehouse.transactions(spark, sf), CAT))


@query(
    "p13_baseline_rate",
    tx("SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives, round(avg(is_fraud), 6) AS baseline_rate FROM tx"),
)
def p13(spark, sf):
    return rounded(profiling.baseline_rate(warehouse.transactions(spark, sf)))


@query(
    "p14_screening_report",
    tx(
        VIF
        + MI
        + f""", nums AS ({number_sql(NUM, extra=", is_fraud AS y")}),
    r AS (SELECT feature, corr(v, y) AS c FROM nums GROUP BY feature)
    SELECT feature, 'keep' AS action, 'label correlation' AS reason, round(c, 6) AS value
      FROM (SELECT * FROM r ORDER BY abs(c) DESC, feature LIMIT 5)
    UNION ALL SELECT feature, 'keep', 'mutual information', round(mi_score, 6) FROM mi WHERE mi_score > 0.01
    UNION ALL SELECT feature, 'drop', 'variance inflation', round(vif, 6) FROM vif WHERE vif > 10"""
    ),
)
def p14(spark, sf):
    return rounded(profiling.screening_report(warehouse.transactions(spark, sf), NUM, CAT))


@query(
    "p15_binned_rates",
    tx("""SELECT CASE WHEN amount >= 2000 THEN '2000+' WHEN amount >= 1000 THEN '1000-2000'
      WHEN amount >= 500 THEN '500-1000' WHEN amount >= 100 THEN '100-500' ELSE '0-100' END AS value_range,
    count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives, round(avg(is_fraud), 6) AS label_rate
    FROM tx GROUP BY 1"""),
)
def p15(spark, sf):
    return rounded(profiling.binned_rates(warehouse.transactions(spark, sf)))


# ---- dataset preparation ---------------------------------------------------------

RANKED = """, ranked AS (
    SELECT transaction_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('1:' || transaction_id)) AS r,
           count(*) OVER (PARTITION BY is_fraud) AS n_class, count(*) OVER () AS n FROM tx),
  sizes AS (SELECT is_fraud, any_value(n_class) AS n_class, any_value(n) AS n FROM ranked GROUP BY is_fraud),
  t0 AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS want FROM sizes),
  t1 AS (SELECT *, n_class * want / n::DOUBLE AS x FROM t0),
  t2 AS (SELECT *, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, is_fraud)
             <= want - CAST(sum(floor(x)) OVER () AS BIGINT) THEN 1 ELSE 0 END AS n_test FROM t1),
  v0 AS (SELECT *, n_class - n_test AS rest, n - want AS n_rest, CAST(ceil((n - want) * 0.25) AS BIGINT) AS want_v FROM t2),
  v1 AS (SELECT *, rest * want_v / n_rest::DOUBLE AS xv FROM v0),
  cut AS (SELECT *, CAST(floor(xv) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY xv - floor(xv) DESC, is_fraud)
             <= want_v - CAST(sum(floor(xv)) OVER () AS BIGINT) THEN 1 ELSE 0 END AS n_val FROM v1),
  parts AS (SELECT transaction_id, r.is_fraud, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'validation'
             ELSE 'train' END AS split FROM ranked r JOIN cut ON r.is_fraud = cut.is_fraud)
"""


def labelled(spark, sf):
    return warehouse.transactions(spark, sf).select("transaction_id", "is_fraud")


@query("d1_stratified_split", tx(RANKED + "SELECT transaction_id, is_fraud, split FROM parts"))
def d1(spark, sf):
    return splits.train_val_test(labelled(spark, sf))


@query(
    "d2_plain_split",
    tx(""", ranked AS (SELECT transaction_id, row_number() OVER (ORDER BY md5('7:' || transaction_id)) AS r,
           count(*) OVER () AS n FROM tx),
    s AS (SELECT *, CAST(ceil(n * 0.15) AS BIGINT) AS n_test FROM ranked),
    v AS (SELECT *, CAST(ceil(round((n - n_test) * (0.15::DOUBLE / (1 - 0.15::DOUBLE)), 6)) AS BIGINT) AS n_val FROM s)
    SELECT transaction_id, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'validation'
      ELSE 'train' END AS split FROM v"""),
)
def d2(spark, sf):
    frame = warehouse.transactions(spark, sf).select("transaction_id")
    return splits.train_val_test(frame, None, 0.7, 0.15, 0.15, seed=7)


@query(
    "d3_train_plus_validation",
    tx(RANKED + "SELECT transaction_id, is_fraud, split FROM parts WHERE split <> 'test'"),
)
def d3(spark, sf):
    parts = splits.train_val_test(labelled(spark, sf))
    return splits.combined(parts.filter("split = 'train'"), parts.filter("split = 'validation'"))


@query(
    "d4_stratified_folds",
    tx(""", ranked AS (SELECT transaction_id, is_fraud,
           row_number() OVER (PARTITION BY is_fraud ORDER BY md5('1:' || transaction_id)) AS r FROM tx),
    start AS (SELECT is_fraud, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY is_fraud
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tx GROUP BY is_fraud),
    slots AS (SELECT r.is_fraud, r.r, CAST((start.s + r.r - 1) % 4 AS INTEGER) AS f FROM ranked r JOIN start
              ON r.is_fraud = start.is_fraud),
    ordered AS (SELECT is_fraud, f, row_number() OVER (PARTITION BY is_fraud ORDER BY f) AS r FROM slots)
    SELECT transaction_id, ranked.is_fraud, o.f AS fold FROM ranked JOIN ordered o
      ON ranked.is_fraud = o.is_fraud AND ranked.r = o.r"""),
)
def d4(spark, sf):
    return splits.stratified_folds(labelled(spark, sf))


@query(
    "d5_class_weight",
    tx("""SELECT count(*) FILTER (is_fraud = 0) AS negatives, count(*) FILTER (is_fraud = 1) AS positives,
    round(count(*) FILTER (is_fraud = 0) / count(*) FILTER (is_fraud = 1)::DOUBLE, 6) AS positive_weight FROM tx"""),
)
def d5(spark, sf):
    return rounded(splits.class_balance(labelled(spark, sf)))


@query(
    "d5_weight_column",
    tx("""SELECT is_fraud, round(sum(CASE WHEN is_fraud = 1 THEN n0 / n1::DOUBLE ELSE 1.0 END), 3) AS total_weight
    FROM tx, (SELECT count(*) FILTER (is_fraud = 0) AS n0, count(*) FILTER (is_fraud = 1) AS n1 FROM tx)
    GROUP BY is_fraud"""),
)
def d5_column(spark, sf):
    weighted = splits.class_weights(labelled(spark, sf))
    return weighted.groupBy("is_fraud").agg(F.round(F.sum("weight"), 3).alias("total_weight"))


@query(
    "d6_split_summary",
    tx(
        RANKED
        + """SELECT split, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM tx)::DOUBLE, 6) AS share,
    CAST(sum(is_fraud) AS BIGINT) AS positives, round(avg(is_fraud), 6) AS positive_rate, 1 AS is_complete
    FROM parts GROUP BY split"""
    ),
)
def d6(spark, sf):
    return rounded(splits.split_summary(splits.train_val_test(labelled(spark, sf))))


# ---- flagship --------------------------------------------------------------------


@query(
    "flagship_rate_by_night_and_mismatch",
    tx(""", zoned AS (SELECT *, coalesce(map {'US': 'America/New_York', 'GB': 'Europe/London', 'FR': 'Europe/Paris',
      'DE': 'Europe/Berlin', 'IT': 'Europe/Rome', 'ES': 'Europe/Madrid', 'CA': 'America/Toronto',
      'AU': 'Australia/Sydney', 'JP': 'Asia/Tokyo', 'BR': 'America/Sao_Paulo'}[country], 'UTC') AS tz FROM tx),
    loc AS (SELECT *, hour((transaction_time AT TIME ZONE 'UTC') AT TIME ZONE tz) AS h FROM zoned)
    SELECT CAST(h >= 23 OR h <= 4 AS INTEGER) AS is_late_night_local,
      CAST(country <> bin_country AS INTEGER) AS country_mismatch, count(*) AS total_count,
      CAST(sum(is_fraud) AS BIGINT) AS target_count, round(avg(is_fraud) * 100, 6) AS target_rate
    FROM loc GROUP BY 1, 2"""),
)
def flagship(spark, sf):
    frame = warehouse.transactions(spark, sf)
    featured = engineered(frame, FittedStatistics.fit(frame))
    return rounded(
        featured.groupBy("is_late_night_local", "country_mismatch").agg(
            F.count(F.lit(1)).alias("total_count"),
            F.sum("is_fraud").alias("target_count"),
            (F.avg("is_fraud") * 100).alias("target_rate"),
        )
    )
