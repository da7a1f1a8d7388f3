"""Explanation records and global importance from per-row contributions (log-odds).

Input rows carry ``contributions`` (array, one entry per feature) and ``bias``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import lookup, sigmoid
from riskweave.sources.scratch import staged

CONTRIBUTOR_BOUNDS = (1, 10)


def display_name(feature: Column) -> Column:
    """Readable name of a feature; an unknown feature keeps its own name."""
    return lookup(fv.FEATURE_LABELS, feature, feature)


def log_odds(contributions: Column, bias: Column) -> Column:
    return bias + F.aggregate(contributions, F.lit(0.0), lambda a, x: a + x)


def probability_shift(contribution: Column, total: Column) -> Column:
    """Probability with the contribution minus probability without it."""
    return sigmoid(total) - sigmoid(total - contribution)


def with_log_odds(frame: DataFrame) -> DataFrame:
    return frame.withColumn("log_odds", log_odds(F.col("contributions"), F.col("bias")))


def top_contributors(
    frame: DataFrame,
    features: Sequence[str] = tuple(fv.MODEL_COLUMNS),
    top_n: int = 3,
    only_positive: bool = True,
    values: Column | None = None,
) -> DataFrame:
    """Add ``top_contributors``: the strongest contributions of each row as an array of structs.

    Sorted by size, equal sizes in feature order.  All work happens inside the row.
    ``values`` may be an array of the features' values, in the same order.
    """
    low, high = CONTRIBUTOR_BOUNDS
    if not low <= top_n <= high:
        raise ValueError(f"top_n must be between {low} and {high}, got {top_n}")
    names = F.array(*[F.lit(f) for f in features])
    labels = F.array(*[F.lit(fv.FEATURE_LABELS.get(f, f)) for f in features])
    framed = with_log_odds(frame)
    indexed = F.transform(
        F.col("contributions"), lambda x, i: F.struct((-F.abs(x)).alias("rank_key"), i.alias("i"), x.alias("x"))
    )
    kept = F.filter(indexed, lambda s: s["x"] > 0) if only_positive else indexed
    first = F.slice(F.sort_array(kept), 1, top_n)  # struct order: size, then feature index
    total = F.col("log_odds")
    records = F.transform(
        first,
        lambda s: F.struct(
            F.get(names, s["i"]).alias("feature"),
            F.get(labels, s["i"]).alias("display_name"),
            (F.get(values, s["i"]) if values is not None else F.lit(None).cast("double")).alias("value"),
            s["x"].alias("contribution_log_odds"),
            probability_shift(s["x"], total).alias("contribution_probability"),
        ),
    )
    return framed.withColumn("top_contributors", records)


def with_explanation(explained: DataFrame, base_rate: float) -> DataFrame:
    """Pack contributors, base rate and final probability into one ``explanation`` struct."""
    return explained.withColumn(
        "explanation",
        F.struct(
            F.col("top_contributors"),
            F.lit(float(base_rate)).alias("base_fraud_rate"),
            sigmoid(F.col("log_odds")).alias("final_fraud_probability"),
            F.lit("shap").alias("explanation_method"),
        ),
    )


def global_importance(frame: DataFrame, features: Sequence[str] = tuple(fv.MODEL_COLUMNS)) -> DataFrame:
    """Mean absolute and mean signed contribution per feature, strongest first.

    One aggregation with two sums per feature; rows are not exploded.
    """
    x = [F.get("contributions", F.lit(i)) for i in range(len(features))]
    sums = frame.agg(
        *[F.avg(F.abs(c)).alias(f"a{i}") for i, c in enumerate(x)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]
    )
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(i).alias("feature_index"),
            F.col(f"a{i}").alias("mean_abs"),
            F.col(f"m{i}").alias("mean_signed"),
        )
        for i, f in enumerate(features)
    ]
    return (
        sums.select(F.explode(F.array(*cells)).alias("row"))
        .select("row.*")
        .withColumn("raises_risk", (F.col("mean_signed") > 0).cast("int"))
        .orderBy(F.col("mean_abs").desc(), "feature_index")
    )


def mean_total_contribution(frame: DataFrame) -> DataFrame:
    """Mean over rows of the summed absolute contributions."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + F.abs(x))
    return frame.agg(F.avg(total).alias("mean_total_abs"), F.count(F.lit(1)).alias("n_rows"))


# The frames below hold one row per feature.


def _feature_window():
    return Window.partitionBy(F.lit(0))


def with_shares(importance: DataFrame, value: str, tie: str = "feature") -> DataFrame:
    """Rank, share and cumulative share of each feature."""
    order = _feature_window().orderBy(F.col(value).desc(), F.col(tie))
    total = F.sum(value).over(_feature_window())
    return importance.withColumns(
        {
            "rank": F.row_number().over(order),
            "share": F.when(total > 0, F.col(value) / total),
            "cumulative_share": F.when(total > 0, F.sum(value).over(order) / total),
        }
    )


def concentration(importance: DataFrame, value: str, tie: str = "feature") -> DataFrame:
    """Share of the top 5 and the top 10 features."""
    ranked = with_shares(importance, value, tie)
    return ranked.agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("share"))).alias("top5_share"),
        F.sum(F.when(F.col("rank") <= 10, F.col("share"))).alias("top10_share"),
    )


def compare_rankings(gain: DataFrame, shap: DataFrame, top_n: int = 20) -> DataFrame:
    """Gain rank against contribution rank: difference and mean rank, best first.

    ``gain`` has (feature, importance), ``shap`` has (feature, mean_abs, mean_signed).
    """
    g_rank = F.row_number().over(_feature_window().orderBy(F.col("importance").desc(), F.col("feature")))
    s_rank = F.row_number().over(_feature_window().orderBy(F.col("mean_abs").desc(), F.col("feature")))
    joined = gain.select("feature", "importance", g_rank.alias("gain_rank")).join(
        shap.select("feature", "mean_abs", "mean_signed", s_rank.alias("shap_rank")), "feature"
    )
    return (
        joined.withColumns(
            {
                "rank_diff": F.col("gain_rank") - F.col("shap_rank"),
                "avg_rank": (F.col("gain_rank") + F.col("shap_rank")) / F.lit(2.0),
            }
        )
        .orderBy("avg_rank", "gain_rank")
        .limit(top_n)
    )


def rank_agreement(comparison: DataFrame) -> DataFrame:
    """Spearman correlation of the two ranks over the compared features (mean ranks on ties)."""

    def mean_rank(c: str) -> Column:
        w = _feature_window().orderBy(c)
        same = Window.partitionBy(c)
        return (F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)).cast("double")

    ranks = comparison.select(mean_rank("gain_rank").alias("g"), mean_rank("shap_rank").alias("s"))
    spread = (F.min("g") < F.max("g")) & (F.min("s") < F.max("s"))
    # the moments, not corr(): a constant side must give NULL, not a division error
    n = F.count(F.lit(1))
    cov = F.avg(F.col("g") * F.col("s")) - F.avg("g") * F.avg("s")
    return ranks.agg(
        n.alias("n_features"),
        F.when(spread, cov / (F.stddev_pop("g") * F.stddev_pop("s"))).alias("spearman"),
    )


def major_disagreements(comparison: DataFrame, at_least: int = 5) -> DataFrame:
    return comparison.filter(F.abs("rank_diff") >= at_least)


def ranked_values(frame: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(value, code): the distinct values of a column with their places in order from 0 as doubles, and how many they are.

    The values are sorted over ranges; only the number of values in each range reaches the driver.
    """
    values = frame.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    ordered = values.repartitionByRange("value").sortWithinPartitions("value")
    numbered = staged(ordered.withColumn("id", F.monotonically_increasing_id()), "ranked")  # range and place in it
    sizes = numbered.groupBy(F.shiftright("id", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    starts, n = {}, 0
    for r in sizes:
        starts[r["range"]] = n
        n += r["n"]
    table = frame.sparkSession.createDataFrame(list(starts.items()), "range long, start long")
    placed = numbered.withColumn("range", F.shiftright("id", 33)).join(F.broadcast(table), "range")  # a row a range
    return placed.select("value", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("double").alias("code")), n


def distribution_sample(
    frame: DataFrame,
    values: Sequence[str],
    features: Sequence[str],
    key: str = "transaction_id",
    rows: int = 1000,
    top_features: int = 20,
    seed: int = 1,
) -> DataFrame:
    """Sampled (feature, value scaled to 0-1, contribution) triples of the strongest features.

    ``values`` are the columns with the features' values, aligned with the contributions.
    The sample is the ``rows`` smallest hashes of seed and key; text values become codes in
    alphabetical order, which are ranked where the values lie and joined to the sample only.
    """
    strongest = [r["feature"] for r in global_importance(frame, features).limit(top_features).collect()]
    text = [c for c in values if dict(frame.dtypes)[c] == "string"]
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    sample = frame.orderBy(h, key).limit(rows)
    numbers = [c for c in values if c not in text]
    low, high = {c: 0.0 for c in text}, {}
    for c in text:
        codes, n = ranked_values(frame, c)
        high[c] = float(n - 1) if n else None
        sample = sample.join(codes.withColumnRenamed("value", c), c, "left").withColumnRenamed("code", f"code_{c}")
    if numbers:
        numeric = {c: F.col(c).cast("double") for c in numbers}
        ends = frame.agg(
            *[F.min(x).alias(f"lo_{c}") for c, x in numeric.items()], *[F.max(x).alias(f"hi_{c}") for c, x in numeric.items()]
        ).first()
        low |= {c: ends[f"lo_{c}"] for c in numbers}
        high |= {c: ends[f"hi_{c}"] for c in numbers}
    cells = []
    for i, (c, f) in enumerate(zip(values, features)):
        if f not in strongest:
            continue
        lo, hi = low[c], high[c]
        number = F.col(f"code_{c}") if c in text else F.col(c).cast("double")
        scaled = (number - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0)
        cells.append(
            F.struct(
                F.lit(f).alias("feature"),
                scaled.alias("scaled_value"),
                F.get("contributions", F.lit(i)).alias("contribution"),
            )
        )
    return sample.select(key, F.explode(F.array(*cells)).alias("row")).select(key, "row.*")


def value_contribution_correlation(
    frame: DataFrame, values: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Correlation of each feature's value with its own contribution; NULL if either is constant."""
    picks, cells = [], []
    for i, (c, f) in enumerate(zip(values, features)):
        v, x = F.col(c).cast("double"), F.get("contributions", F.lit(i))
        picks += [
            F.covar_pop(v, x).alias(f"c{i}"),
            F.stddev_pop(v).alias(f"v{i}"),
            F.stddev_pop(x).alias(f"x{i}"),
        ]
        spread = F.col(f"v{i}") * F.col(f"x{i}")
        cells.append(
            F.struct(F.lit(f).alias("feature"), F.when(spread > 0, F.col(f"c{i}") / spread).alias("correlation"))
        )
    return frame.agg(*picks).select(F.explode(F.array(*cells)).alias("row")).select("row.*")
