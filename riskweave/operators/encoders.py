"""Model input encodings as ML estimators: ordinal codes for trees, scaled dummies for linear models."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.expressions import lookup

UNKNOWN_CODE = -1.0
MAX_LABELS = 100_000  # values of a category that a model can hold; more are not a category


def category_labels(frame: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Labels of each categorical column in alphabetical order; ValueError above ``MAX_LABELS``."""
    labels = {}
    for c in columns:
        if frame.select(c).distinct().limit(MAX_LABELS + 2).count() > MAX_LABELS + 1:  # one may be null
            raise ValueError(f"column {c!r} has more than {MAX_LABELS} values; a model cannot hold them as categories")
        indexer = StringIndexer(inputCol=c, outputCol="_i", stringOrderType="alphabetAsc", handleInvalid="keep")
        labels[c] = list(indexer.fit(frame.select(F.col(c).cast("string").alias(c))).labels)
    return labels


class _EncoderParams(Params):
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    fitted = Param(Params._dummy(), "fitted", "learned values, as JSON", TypeConverters.toString)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault("fitted"))


class OrdinalCodes(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Replace each category by its alphabetical index; an unseen or missing one becomes -1."""

    @keyword_only
    def __init__(self, *, categorical=None):
        super().__init__()
        self._set(categorical=categorical or list(fv.CATEGORICAL_FEATURES))

    def _fit(self, dataset: DataFrame) -> OrdinalCodesModel:
        columns = self.getOrDefault("categorical")
        labels = category_labels(dataset, columns)
        return OrdinalCodesModel()._set(categorical=columns, fitted=json.dumps(labels))


class OrdinalCodesModel(Model, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for c, labels in self.learned().items():
            codes = {label: float(i) for i, label in enumerate(labels)}
            out[f"{c}_code"] = lookup(codes, F.col(c).cast("string"), F.lit(UNKNOWN_CODE)) if codes else F.lit(UNKNOWN_CODE)
        return dataset.withColumns(out)


class ScaledDummies(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise numbers by mean and population deviation; one-hot categories without the first.

    An unseen category has all dummies zero; a constant column is only centred.
    """

    scaled = Param(Params._dummy(), "scaled", "columns to standardise", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, categorical=None, scaled=None):
        super().__init__()
        self._set(
            categorical=categorical or list(fv.CATEGORICAL_FEATURES),
            scaled=scaled or list(fv.CONTINUOUS_FEATURES + fv.BINARY_FEATURES),
        )

    def _fit(self, dataset: DataFrame) -> ScaledDummiesModel:
        columns = self.getOrDefault("scaled")
        row = dataset.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        learned = {
            "labels": category_labels(dataset, self.getOrDefault("categorical")),
            "scale": {c: [row[f"m_{c}"], row[f"s_{c}"] or 1.0] for c in columns},
        }
        return ScaledDummiesModel()._set(categorical=self.getOrDefault("categorical"), fitted=json.dumps(learned))


class ScaledDummiesModel(Model, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = self.learned()
        out = {f"{c}_z": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in learned["scale"].items()}
        for c, labels in learned["labels"].items():
            for label in labels[1:]:
                hit = F.coalesce(F.col(c).cast("string") == F.lit(label), F.lit(False))
                out[f"{c}_is_{label}"] = hit.cast("double")
        ready = dataset.withColumns(out)
        # the dummies' names depend on the data, so they are packed here into one vector column
        dummies = [n for n in out if "_is_" in n and not n.endswith("_z")]
        return VectorAssembler(inputCols=dummies, outputCol="dummies").transform(ready) if dummies else ready.withColumn(
            "dummies", F.lit(None)
        )


# --- fixed values: names by which a model family may be asked for -----------------
FAMILY_ALIASES = {
    "logistic": "linear",
    "logistic_regression": "linear",
    "lr": "linear",
    "linear": "linear",
    "tree": "tree",
    "random_forest": "tree",
    "rf": "tree",
    "xgboost": "tree",
    "xgb": "tree",
    "boosted_trees": "tree",
    "gbt": "tree",
}


def tree_inputs() -> list[str]:
    return [f"{c}_code" for c in fv.CATEGORICAL_FEATURES] + fv.CONTINUOUS_FEATURES + fv.BINARY_FEATURES


def tree_encoding() -> Pipeline:
    """Ordinal codes, then all 30 columns in model order; other columns take no part."""
    return Pipeline(
        stages=[
            OrdinalCodes(categorical=list(fv.CATEGORICAL_FEATURES)),
            VectorAssembler(inputCols=tree_inputs(), outputCol="features", handleInvalid="keep"),
        ]
    )


def linear_encoding(scale_binary: bool = True) -> Pipeline:
    scaled = fv.CONTINUOUS_FEATURES + (fv.BINARY_FEATURES if scale_binary else [])
    plain = [] if scale_binary else fv.BINARY_FEATURES
    inputs = [f"{c}_z" for c in scaled] + list(plain) + ["dummies"]
    return Pipeline(
        stages=[
            ScaledDummies(categorical=list(fv.CATEGORICAL_FEATURES), scaled=list(scaled)),
            VectorAssembler(inputCols=inputs, outputCol="features"),
        ]
    )


def encoding_for(family: str) -> Pipeline:
    kind = FAMILY_ALIASES.get(family.lower())
    if kind is None:
        raise ValueError(f"unknown model family {family!r}, have {sorted(FAMILY_ALIASES)}")
    return tree_encoding() if kind == "tree" else linear_encoding()
