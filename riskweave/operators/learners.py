"""The three classifiers as weighted Spark ML pipelines over engineered features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.operators import boosting, deep_forest
from riskweave.operators.encoders import linear_encoding, tree_encoding
from riskweave.operators.splits import class_weights
from riskweave.sources.scratch import few_parts

LABEL, WEIGHT = "is_fraud", "weight"
LINEAR, FOREST, BOOSTED = "logistic_regression", "random_forest", "boosted_trees"

# --- fixed values: parameters used when none are given ---------------------------
BASELINE = {
    LINEAR: {"max_iter": 1000},
    FOREST: {"n_estimators": 100, "class_weight": "balanced"},
    BOOSTED: {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1},
}

# --- fixed values: parameters that have no counterpart in Spark's learners -------
RECORDED_ONLY = {
    LINEAR: set(),
    FOREST: {"min_samples_split", "class_weight"},
    BOOSTED: {"gamma", "reg_alpha", "reg_lambda"},
}

# --- fixed values: accepted names of the families ---------------------------------
FAMILY_NAMES = {
    "logistic_regression": LINEAR,
    "logistic": LINEAR,
    "lr": LINEAR,
    "random_forest": FOREST,
    "rf": FOREST,
    "boosted_trees": BOOSTED,
    "gbt": BOOSTED,
    "xgboost": BOOSTED,
    "xgb": BOOSTED,
}


def family_of(name: str) -> str:
    found = FAMILY_NAMES.get(name.lower())
    if found is None:
        raise ValueError(f"unsupported model family {name!r}, have {sorted(FAMILY_NAMES)}")
    return found


def weighted(frame: DataFrame, family: str, params: Mapping | None = None) -> DataFrame:
    """Add the ``weight`` column the family trains with.

    Boosted trees weigh positives by ``scale_pos_weight`` (default negatives/positives), the
    others balance the classes.
    """
    if family == BOOSTED:
        given = (params or {}).get("scale_pos_weight")
        if given is None:
            return class_weights(frame, LABEL, "positive")
        return frame.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(float(given))).otherwise(F.lit(1.0)))
    return class_weights(frame, LABEL, "balanced")


MAX_BINS = 256  # candidate cuts of a numeric feature, for both tree learners
DEEPEST = 30  # Spark's own limit; a forest without max_depth grows to it
LEVELS = 12  # depth up to which Spark grows a forest, level by level; deeper ones have nodes of few rows


def forest_depth(wanted) -> int:
    depth = DEEPEST if wanted is None else int(wanted)
    if depth > DEEPEST:
        raise ValueError(f"max_depth {depth} is above Spark's limit of {DEEPEST}")
    return depth


def ridge(frame: DataFrame, c: float = 1.0) -> float:
    """Spark's ``regParam`` for an inverse penalty ``c``: the loss here is a weighted mean, there a weighted sum."""
    total = frame.agg(F.sum(WEIGHT)).first()[0]
    return 1.0 / (c * total) if total else 0.0


def _feature_share(value) -> str:
    return value if isinstance(value, str) else str(float(value))


def learner(family: str, params: Mapping | None = None, seed: int = fv.DEFAULT_SEED) -> Pipeline:
    """Encoding plus classifier.

    Boosted trees take n_estimators, max_depth, learning_rate, subsample, colsample_bytree and
    min_child_weight.  gamma, reg_alpha and reg_lambda have no counterpart in Spark's learner
    (its minimum gain is measured on another scale) and are only recorded.
    """
    p = {**BASELINE[family], **(params or {})}
    common = {"labelCol": LABEL, "weightCol": WEIGHT, "featuresCol": "features"}
    if family == LINEAR:
        classifier = LogisticRegression(
            maxIter=int(p["max_iter"]), regParam=float(p.get("reg_param", 0.0)), standardization=False, **common
        )
        return Pipeline(stages=[linear_encoding(), classifier])
    if family == FOREST:
        classifier = RandomForestClassifier(
            numTrees=int(p["n_estimators"]),
            maxDepth=forest_depth(p.get("max_depth")),
            maxBins=int(p.get("max_bins", MAX_BINS)),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_feature_share(p.get("max_features", "sqrt")),
            seed=seed,
            **common,
        )
    else:
        share = float(p.get("colsample_bytree", 1.0))
        classifier = GBTClassifier(
            maxIter=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            maxBins=int(p.get("max_bins", MAX_BINS)),
            stepSize=float(p["learning_rate"]),
            subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy="all" if share >= 1.0 else str(share),
            minInstancesPerNode=int(p.get("min_child_weight", 1)),
            seed=seed,
            **common,
        )
    return Pipeline(stages=[tree_encoding(), classifier])


IN_SEARCH: ContextVar[bool] = ContextVar("in_search", default=False)


@contextmanager
def in_search() -> Iterator[None]:
    """Fits made here belong to a search, whose fits run side by side."""
    token = IN_SEARCH.set(True)
    try:
        yield
    finally:
        IN_SEARCH.reset(token)


def fit(frame: DataFrame, family: str, params: Mapping | None = None, seed: int = fv.DEFAULT_SEED) -> PipelineModel:
    one_of_many = IN_SEARCH.get()
    rows = weighted(few_parts(frame, frame.count()), family, params)
    p = dict(params or {})
    if family == LINEAR and "reg_param" not in p:
        p["reg_param"] = ridge(rows, float(p.get("C", 1.0)))
    pipeline = learner(family, p, seed)
    if family == BOOSTED or family == FOREST and (one_of_many or forest_depth(p.get("max_depth")) > LEVELS):
        encoding, trees = pipeline.getStages()
        encoder = encoding.fit(rows)
        encoded = encoder.transform(rows)
        return PipelineModel([encoder, boosting.fit(encoded, trees, one_of_many) if family == BOOSTED else deep_forest.fit(encoded, trees)])
    return pipeline.fit(rows)


def followed(frame: DataFrame, others: DataFrame, params: Mapping | None = None, seed: int = fv.DEFAULT_SEED) -> list[tuple[float | None, float | None]]:
    """PR-AUC on the rows of a boosted fit and on ``others`` after each round."""
    rows = weighted(few_parts(frame, frame.count()), BOOSTED, params)
    encoding, trees = learner(BOOSTED, params, seed).getStages()
    encoder = encoding.fit(rows)
    return boosting.followed(encoder.transform(rows), encoder.transform(others), trees)


def predicted(model: PipelineModel, frame: DataFrame, probability: str = "probability_fraud") -> DataFrame:
    """Add the positive-class probability as a double; input columns are kept, model columns are not."""
    kept = frame.columns
    scored = model.transform(frame).withColumn(probability, vector_to_array("probability")[1])
    return scored.select(*kept, probability)


def scored_table(model: PipelineModel, frame: DataFrame, *keep: str) -> DataFrame:
    """(keep..., label, score) as the evaluation operators expect."""
    rows = predicted(model, frame)
    return rows.select(*keep, F.col(LABEL).alias("label"), F.col("probability_fraud").alias("score"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
