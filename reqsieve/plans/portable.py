"""The trained model as a plain table, and a scorer read from that table.

Rows are ``(model_date, feature, kind, category, coefficient)`` with kind
``intercept``, ``numeric`` or ``category``. The categories listed for a feature
are the ones the model has seen, the one-hot reference category included
(coefficient 0).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.plans.training import TableModel, WideModel
from reqsieve.schemas import COEFFICIENTS, check_declared
from reqsieve.sizing import join_side

INTERCEPT, NUMERIC, CATEGORY = "intercept", "numeric", "category"
# Up to this many categories of a feature become a CASE expression inside the
# generated code; more are looked up by a join.
INLINE_CATEGORIES = 64
# Coefficients handed to Spark at once.
SLOT_ROWS = 1_000_000


@dataclass(frozen=True)
class PortableModel:
    """A scorer built from a coefficient table.

    Only the numeric weights and short category lists are held on the driver;
    a feature with many categories stays a DataFrame and is joined.
    """

    intercept: float
    numeric_weights: Mapping[str, float]
    categories: Mapping[str, Mapping[str, float] | DataFrame]
    features: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        if not self.features:
            object.__setattr__(self, "features", (*self.numeric_weights, *self.categories))

    @property
    def category_features(self) -> Sequence[str]:
        return tuple(self.categories)

    def inline_weights(self, feature: str) -> Mapping[str, float] | None:
        weights = self.categories[feature]
        return None if isinstance(weights, DataFrame) else weights

    def weight_table(self, feature: str) -> DataFrame:
        return self.categories[feature]

    @classmethod
    def from_table(cls, table: DataFrame, inline_limit: int = INLINE_CATEGORIES) -> PortableModel:
        """Read a model of one date. Raises when the table holds no such model."""
        names = F.count_distinct(F.coalesce("category", F.lit("")))
        sizes = table.groupBy("feature", "kind").agg(F.count(F.lit(1)).alias("n"), names.alias("names")).collect()
        if sum(r.n for r in sizes if r.kind == INTERCEPT) != 1 or any(r.n != r.names for r in sizes):
            raise ValueError("the coefficient table must hold exactly one model, each coefficient once")
        small = sorted(r.feature for r in sizes if r.kind == CATEGORY and r.n <= inline_limit)
        large = sorted(r.feature for r in sizes if r.kind == CATEGORY and r.n > inline_limit)
        is_small = (F.col("kind") != CATEGORY) | F.col("feature").isin(small)
        # At most one row per numeric feature and inline_limit rows per short list.
        rows = table.filter(is_small).select("feature", "kind", "category", "coefficient").collect()
        categories: dict[str, Mapping[str, float] | DataFrame] = {
            f: {r.category: r.coefficient for r in sorted(rows, key=lambda r: r.category or "") if r.feature == f and r.kind == CATEGORY}
            for f in small
        }
        for f in large:
            entries = table.filter((F.col("kind") == CATEGORY) & (F.col("feature") == f))
            categories[f] = join_side(entries.select("category", "coefficient"))
        return cls(
            intercept=next(r.coefficient for r in rows if r.kind == INTERCEPT),
            numeric_weights={r.feature: r.coefficient for r in sorted(rows, key=lambda r: r.feature) if r.kind == NUMERIC},
            categories=dict(sorted(categories.items())),
        )


def coefficient_rows(
    model_date: str, intercept: float, numeric: Mapping[str, float], categories: Mapping[str, Mapping[str, float]]
) -> list[tuple]:
    rows: list[tuple] = [(model_date, "(intercept)", INTERCEPT, None, float(intercept))]
    rows += [(model_date, f, NUMERIC, None, float(w)) for f, w in numeric.items()]
    rows += [(model_date, f, CATEGORY, c, float(w)) for f, ws in categories.items() for c, w in ws.items()]
    return rows


def coefficient_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), COEFFICIENTS)


def _check_fields(declared: T.StructType, numeric: Iterable[str], categories: Iterable[str]) -> None:
    """Raise unless every model input is declared, categories as text and the rest as numbers."""
    wanted = [(f, T.NumericType, "a number") for f in numeric] + [(f, T.StringType, "text") for f in categories]
    kinds = {f.name: f.dataType for f in declared.fields}
    problems = [f"{name} must be {label}" for name, kind, label in wanted if not isinstance(kinds.get(name), kind)]
    if problems:
        raise ValueError("the declared schema does not fit the model: " + ", ".join(problems))


def coefficient_table(
    spark: SparkSession, model: PipelineModel | WideModel | TableModel, model_date: str, declared: T.StructType | None = None
) -> DataFrame:
    """The coefficient table of a fitted index / one-hot / assemble / LR pipeline, or of a ``fit_wide`` model.

    ``declared`` is the schema the caller promises to score with; a model that
    needs other fields is not exported. The table has the size of the fitted
    model, which Spark ML keeps on the driver.
    """
    if isinstance(model, (WideModel, TableModel)):
        return wide_coefficient_table(spark, model, model_date, declared)
    indexers = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    encoder = next((s for s in model.stages if isinstance(s, OneHotEncoderModel)), None)
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    lr = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    weights = lr.coefficients.toArray()
    labels_of: dict[str, tuple[str, list[str]]] = {}
    if encoder is not None:
        index_of = dict(zip(encoder.getOutputCols(), encoder.getInputCols()))
        names = {}
        for indexer in indexers:
            many = indexer.isSet(indexer.inputCols)
            inputs = indexer.getInputCols() if many else [indexer.getInputCol()]
            outputs = indexer.getOutputCols() if many else [indexer.getOutputCol()]
            names.update(zip(outputs, zip(inputs, map(list, indexer.labelsArray))))
        labels_of = {vector: names[index] for vector, index in index_of.items()}
    numeric: dict[str, float] = {}
    categories: dict[str, dict[str, float]] = {}
    at = 0
    for column in assembler.getInputCols():
        if column not in labels_of:
            numeric[column] = float(weights[at])
            at += 1
            continue
        feature, labels = labels_of[column]
        width = len(labels) - (1 if encoder.getDropLast() else 0)
        own = [float(w) for w in weights[at : at + width]] + [0.0] * (len(labels) - width)
        categories[feature] = dict(zip(labels, own))
        at += width
    if at != len(weights):
        raise ValueError("pipeline stages do not line up with the coefficients")
    if declared is not None:
        _check_fields(declared, numeric, categories)
    return coefficient_frame(spark, coefficient_rows(model_date, lr.intercept, numeric, categories))


def wide_coefficient_table(
    spark: SparkSession, model: WideModel | TableModel, model_date: str, declared: T.StructType | None = None
) -> DataFrame:
    """The coefficient table of a ``fit_wide`` model; categories never leave their table."""
    if isinstance(model, TableModel):
        if declared is not None:
            _check_fields(declared, model.numeric_weights, model.encoding.categorical)
        frame = coefficient_frame(spark, coefficient_rows(model_date, model.intercept, model.numeric_weights, {}))
        kind, date = F.lit(CATEGORY).alias("kind"), F.lit(model_date).alias("model_date")
        return frame.unionByName(model.entries.select(date, "feature", kind, "category", "coefficient")) if model.encoding.categorical else frame
    if declared is not None:
        _check_fields(declared, model.numeric, model.sizes)
    weights = model.regression.coefficients.toArray()
    numbers = dict(zip(model.numeric, weights))
    frame = coefficient_frame(spark, coefficient_rows(model_date, model.regression.intercept, numbers, {}))
    at = len(model.numeric)
    for feature, size in model.sizes.items():
        own = weights[at : at + max(size - 1, 0)]
        at += len(own)
        used = own.nonzero()[0]
        # the vector is on the driver already: Spark ML's regression keeps it there
        slots = None
        for first in range(0, max(1, len(used)), SLOT_ROWS):
            part = used[first : first + SLOT_ROWS]
            rows = spark.createDataFrame(pd.DataFrame({"idx": part.astype("int64"), "weight": own[part]}), "idx long, weight double")
            slots = rows if slots is None else slots.unionByName(rows)
        side = join_side(slots, known_bytes=32 * len(used))
        entries = model.categories.filter(F.col("feature") == feature).join(side, "idx", "left")
        frame = frame.unionByName(
            entries.select(
                F.lit(model_date).alias("model_date"),
                "feature",
                F.lit(CATEGORY).alias("kind"),
                "category",
                F.coalesce("weight", F.lit(0.0)).alias("coefficient"),
            )
        )
    return frame


def export(
    spark: SparkSession, model: PipelineModel | WideModel | TableModel, model_date: str, declared: T.StructType, rows: DataFrame
) -> DataFrame:
    """The coefficient table of a model under the schema its inputs are declared with.

    Refused if the model needs a field that is not declared, or of another kind, or if ``rows``, which the
    model is to score, lack a declared field or have a null where it is declared NOT NULL.
    """
    check_declared(rows, declared)
    return coefficient_table(spark, model, model_date, declared)
