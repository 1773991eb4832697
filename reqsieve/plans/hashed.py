"""Training with hashed categories: a coefficient vector of one width, however many categories there are.

A category's slot follows from its name, so nothing is counted, joined or kept before a fit,
and a new category has a slot like any other. Categories that meet in a slot share its coefficient;
``collisions`` tells how many do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.plans.training import CATEGORICAL, FEATURES, NUMERIC, _settings, complete, hash_bucket, overrides, regression
from reqsieve.schemas import LABEL

#: Slots of each feature.
WIDTH = 1 << 18


def slot(feature: str, width: int = WIDTH) -> Column:
    """The slot of a row's category; null for a null category."""
    return hash_bucket(F.concat(F.lit(f"{feature}="), F.col(feature).cast("string")), width)


def _slot_name(feature: str) -> str:
    return f"{feature}_slot"


def _vector_name(feature: str) -> str:
    return f"{feature}_slots"


@dataclass(frozen=True)
class HashedEncoding:
    categorical: Sequence[str] = CATEGORICAL
    numeric: Sequence[str] = NUMERIC
    width: int = WIDTH

    def _stages(self, shape: DataFrame) -> PipelineModel:
        slots, vectors = [_slot_name(c) for c in self.categorical], [_vector_name(c) for c in self.categorical]
        stages = [OneHotEncoder(inputCols=slots, outputCols=vectors, dropLast=False)] if self.categorical else []
        return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*self.numeric, *vectors], outputCol=FEATURES)]).fit(shape)

    def _slotted(self, rows: DataFrame) -> DataFrame:
        # the encoder takes its width from here instead of scanning for it
        nominal = {"ml_attr": {"type": "nominal", "num_vals": self.width}}
        return rows.withColumns({_slot_name(c): slot(c, self.width).cast("double").alias(_slot_name(c), metadata=nominal) for c in self.categorical})

    def assemble(self, rows: DataFrame, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """``features`` and the columns ``keep`` of the rows without a null number or category."""
        columns = dict.fromkeys([*self.numeric, *self.categorical, *keep])
        whole = rows.select(*columns)
        if self.numeric:
            whole = complete(whole, self.numeric, self.numeric[0])
        slotted = self._slotted(whole.dropna(subset=list(self.categorical)) if self.categorical else whole)
        return self._stages(slotted.limit(0)).transform(slotted).select(FEATURES, *keep)


@dataclass(frozen=True)
class HashedModel:
    regression: LogisticRegressionModel
    encoding: HashedEncoding

    def transform(self, rows: DataFrame, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """Predictions for every complete row, also of categories that were not there at the fit."""
        return self.regression.transform(self.encoding.assemble(rows, keep))


def fit_hashed(
    train: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    width: int = WIDTH,
    label: str = LABEL,
    params: Mapping[str, float] | None = None,
) -> HashedModel:
    """The regression of ``fit`` over ``width`` slots per categorical feature."""
    encoding, lr = HashedEncoding(tuple(categorical), tuple(numeric), width), regression(label)
    ready = encoding.assemble(complete(train, numeric, label), [label])
    return HashedModel(lr.fit(ready, overrides(lr, **_settings(params))), encoding)


def collisions(rows: DataFrame, categorical: Sequence[str] = CATEGORICAL, width: int = WIDTH) -> DataFrame:
    """``(feature, slots, categories, colliding)``: slots in use, categories, and those that share a slot with another."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"), slot(c, width).alias("slot")) for c in categorical]
    known = rows.select(F.inline(F.array(*pairs))).filter("category IS NOT NULL").distinct()
    by_slot = known.groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("n"))
    return by_slot.groupBy("feature").agg(
        F.count(F.lit(1)).alias("slots"), F.sum("n").alias("categories"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("colliding")
    )
