"""The feature chain as a Spark ML estimator, so it can sit in a saved pipeline."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv
from riskweave.functions.temporal import require_utc_wall_time
from riskweave.operators.features import FittedStatistics, engineered


class _FeaturizerParams(Params):
    timeColumn = Param(Params._dummy(), "timeColumn", "UTC event time column", TypeConverters.toString)
    countryColumn = Param(Params._dummy(), "countryColumn", "country column", TypeConverters.toString)
    zones = Param(Params._dummy(), "zones", "country to zone map, as JSON", TypeConverters.toString)
    keepColumns = Param(Params._dummy(), "keepColumns", "columns carried along", TypeConverters.toListString)

    def _defaults(self) -> None:
        self._setDefault(
            timeColumn="transaction_time",
            countryColumn="country",
            zones=json.dumps(fv.COUNTRY_ZONES),
            keepColumns=[],
        )


class TransactionFeaturizer(Estimator, _FeaturizerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the percentiles from the frame it is fitted on; fit it on training rows only."""

    @keyword_only
    def __init__(self, *, timeColumn=None, countryColumn=None, zones=None, keepColumns=None):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TransactionFeaturizerModel:
        require_utc_wall_time(dataset, self.getOrDefault("timeColumn"))
        stats = FittedStatistics.fit(dataset)
        model = TransactionFeaturizerModel()
        for name in ("timeColumn", "countryColumn", "zones", "keepColumns"):
            model._set(**{name: self.getOrDefault(name)})
        return model._set(
            amountP95=stats.amount_p95, transactionsP75=stats.transactions_p75, distanceP75=stats.distance_p75
        )

    def fit_transform(self, dataset: DataFrame) -> DataFrame:
        return self.fit(dataset).transform(dataset)


class TransactionFeaturizerModel(Model, _FeaturizerParams, DefaultParamsReadable, DefaultParamsWritable):
    amountP95 = Param(Params._dummy(), "amountP95", "95th percentile of amount", TypeConverters.toFloat)
    transactionsP75 = Param(Params._dummy(), "transactionsP75", "75th percentile of totals", TypeConverters.toInt)
    distanceP75 = Param(Params._dummy(), "distanceP75", "75th percentile of distance", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._defaults()

    @staticmethod
    def from_statistics(stats: FittedStatistics) -> TransactionFeaturizerModel:
        return TransactionFeaturizerModel()._set(
            timeColumn=stats.time_column,
            countryColumn=stats.country_column,
            zones=json.dumps(dict(stats.zones)),
            amountP95=stats.amount_p95,
            transactionsP75=stats.transactions_p75,
            distanceP75=stats.distance_p75,
        )

    def statistics(self) -> FittedStatistics:
        if not self.isDefined("amountP95"):
            raise ValueError("the featurizer is not fitted")
        return FittedStatistics(
            self.getOrDefault("amountP95"),
            self.getOrDefault("transactionsP75"),
            self.getOrDefault("distanceP75"),
            json.loads(self.getOrDefault("zones")),
            time_column=self.getOrDefault("timeColumn"),
            country_column=self.getOrDefault("countryColumn"),
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stats = self.statistics()
        keep = [F.col(c) for c in self.getOrDefault("keepColumns") if c in dataset.columns]
        return engineered(dataset, stats).select(*keep, *stats.final_features)
