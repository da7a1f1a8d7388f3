"""Transactions, scores and experiment logs derived from the warehouse tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.scratch import spread

# --- fixed values: domain of the derived columns ------------------------------
COUNTRIES = ["US", "GB", "FR", "DE", "IT", "ES", "CA", "AU", "JP", "BR", "NL", "TR"]
CATEGORIES = ["electronics", "fashion", "grocery", "gaming", "travel"]


# Column types of the warehouse tables; stating them saves the job that would read them from the files.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction table: orders joined to per-user facts.

    Per-user facts come from a map-side-combined ``groupBy`` joined back, not from a
    window over the user, so a user with a large share of the rows never has to fit
    in one task; adaptive execution splits such a key on the join.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cents = F.floor(F.col("o_totalprice") / F.lit(5.0)).cast("bigint")
    facts = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(cents).alias("sum_cents"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.pmod("c_nationkey", F.lit(12)).cast("int").alias("home")
    )
    joined = orders.join(facts.join(customers, "o_custkey"), "o_custkey")

    k = F.col("o_orderkey")
    base = joined.select(
        k.alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.datediff("o_orderdate", "first_order").alias("account_age_days"),
        F.col("n_orders").cast("int").alias("total_transactions_user"),
        (F.expr("sum_cents div n_orders") / F.lit(100.0)).alias("avg_amount_user"),
        (cents / F.lit(100.0)).alias("amount"),
        _pick(COUNTRIES, F.col("home")).alias("country"),
        _pick(COUNTRIES, F.when(k % 7 == 0, (F.col("home") + 1) % 12).otherwise(F.col("home"))).alias("bin_country"),
        F.when(k % 2 == 0, "web").otherwise("app").alias("channel"),
        _pick(CATEGORIES, k % 5).alias("merchant_category"),
        (k % 5 == 0).cast("int").alias("promo_used"),
        (k % 11 != 0).cast("int").alias("avs_match"),
        (k % 13 != 0).cast("int").alias("cvv_result"),
        (k % 3 != 0).cast("int").alias("three_ds_flag"),
        F.when(k % 4 == 0, F.lit(0.0)).otherwise(((k * 37) % 50000) / F.lit(10.0)).alias("shipping_distance_km"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400)")).alias(
            "transaction_time"
        ),
    )
    risky = (
        ((F.col("account_age_days") <= 30) & (F.col("promo_used") == 1) & (F.col("three_ds_flag") == 0))
        | ((F.col("country") != F.col("bin_country")) & (F.col("avs_match") == 0))
        | ((F.col("shipping_distance_km") > 4500) & (F.col("amount") > 900))
        | (F.col("transaction_id") % 97 == 0)
    )
    return base.withColumn("is_fraud", risky.cast("int"))


def with_score(frame: DataFrame) -> DataFrame:
    """A deterministic score with many ties, between 0 and 0.999."""
    raw = F.expr("(transaction_id * 7919 % 1000) * 6 div 10") + F.lit(350) * F.col("is_fraud")
    return frame.withColumn("score", F.least(F.lit(999), raw) / F.lit(1000.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(transactions(spark, sf_dir)).select(
        "transaction_id", F.col("is_fraud").alias("label"), "score"
    )


def two_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models on two datasets, for the comparison operators."""
    base = scored(spark, sf_dir)
    k = F.col("transaction_id")
    flat = F.expr("(transaction_id * 104729 % 1000) * 8 div 10") + F.lit(150) * F.col("label")
    variants = F.explode(
        F.array(
            F.struct(F.lit("boosted_trees").alias("model"), F.col("score").alias("score")),
            F.struct(
                F.lit("random_forest").alias("model"), (F.least(F.lit(999), flat) / F.lit(1000.0)).alias("score")
            ),
        )
    )
    return base.select(
        "transaction_id",
        "label",
        F.when(k % 4 == 0, "test").otherwise("validation").alias("dataset"),
        variants.alias("v"),
    ).select("transaction_id", "label", "dataset", "v.model", "v.score")


def contributions(spark: SparkSession, sf_dir: str, width: int = 30) -> DataFrame:
    """Per-transaction contribution arrays in log-odds, one entry per model feature."""
    k = F.col("transaction_id")
    return scored(spark, sf_dir).select(
        "transaction_id",
        "label",
        F.lit(-3.0).alias("bias"),
        F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda j: ((k * (j + 3) * 31 + j * 17) % 401 - 190 - j * 3) / F.lit(100.0),
        ).alias("contributions"),
    )


def candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log, one value per candidate, fold, split and metric, derived from parts.

    Forty part keys make a run: two models with twenty candidates each.
    """
    p = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part").select("p_partkey")).select(  # a part makes 24 rows
        p.alias("k"),
        F.expr("cast(p_partkey div 40 as string)").alias("run_id"),
        F.when(p % 2 == 0, "random_forest").otherwise("boosted_trees").alias("model"),
        F.expr("cast((p_partkey % 40) div 2 as int)").alias("candidate_id"),
    )
    folds = parts.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    k, f = F.col("k"), F.col("fold")
    test = 7000 + (k * 397 + f * 53) % 1500
    train = test + (k * 13 + f * 7) % 1300
    cells = [
        ("test", "pr_auc", test / F.lit(10000.0)),
        ("train", "pr_auc", train / F.lit(10000.0)),
        ("test", "roc_auc", (test + 900) / F.lit(10000.0)),
        ("train", "roc_auc", (train + 500) / F.lit(10000.0)),
        ("time", "fit_time", ((k * 31 + f * 11) % 900 + 100) / F.lit(100.0)),
        ("time", "score_time", ((k * 17 + f * 5) % 90 + 10) / F.lit(1000.0)),
    ]
    exploded = folds.select(
        "run_id",
        "model",
        "candidate_id",
        F.create_map(
            F.lit("n_estimators"),
            (F.col("candidate_id") * 10 + 10).cast("string"),
            F.lit("max_depth"),
            (F.pmod("k", F.lit(3)) + 4).cast("string"),
        ).alias("params"),
        F.col("fold"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("split"), F.lit(m).alias("metric"), v.alias("value"))
                    for s, m, v in cells
                ]
            )
        ).alias("cell"),
    )
    return exploded.select(
        "run_id", "model", "candidate_id", "params", "fold", "cell.split", "cell.metric", "cell.value"
    )
