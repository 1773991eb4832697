"""Request rows to ``(status, to_filter, precision)`` as plain column expressions.

The same functions serve batch and streaming DataFrames: nothing here shuffles
unless the model's category table was counted too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Container, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.functions import logistic
from reqsieve.functions.parsing import parse_double

OK, FAILURE = "ok", "failure"
MISSING, NULL, BAD_TYPE, UNSEEN = "missing_field", "null_value", "bad_type", "unseen_category"
# What a request gets when no prediction could be made.
NO_PREDICTION = {"features_id": "NA", "to_filter": False, "precision": 0.0}

_WEIGHT = "__w_{}"
_NUMBER = "__x_{}"
_MARGIN = "__margin"
_PROBLEM = "__problem"


def _numeric_value(df: DataFrame, feature: str) -> Column | None:
    kind = df.schema[feature].dataType
    if isinstance(kind, T.NumericType):
        return F.col(feature).cast("double")
    if isinstance(kind, T.StringType):
        return parse_double(F.col(feature))
    return None


def _inline_weight(feature: str, weights: Mapping[str, float]) -> Column:
    text = F.col(feature).cast("string")
    (category, weight), *others = weights.items()
    return reduce(lambda chain, item: chain.when(text == item[0], item[1]), others, F.when(text == category, weight))


def _attach_inputs(df: DataFrame, model) -> DataFrame:
    """The number or category weight of every model input the table has.

    A weight is null where the category is unseen, a number where the text is none.
    """
    present, inputs = set(df.columns), {}
    for feature in model.features:
        if feature not in present:
            continue
        if feature not in model.category_features:
            value = _numeric_value(df, feature)
            inputs[_NUMBER.format(feature)] = F.lit(None).cast("double") if value is None else value
        elif model.inline_weights(feature) is not None:
            inputs[_WEIGHT.format(feature)] = _inline_weight(feature, model.inline_weights(feature))
        else:
            key = f"__k_{feature}"
            side = model.weight_table(feature).select(
                F.col("category").alias(key), F.col("coefficient").alias(_WEIGHT.format(feature))
            )
            df = df.join(side, F.col(feature).cast("string") == F.col(key), "left").drop(key)
    return df.withColumns(inputs) if inputs else df


def _first_problem(df: DataFrame, model) -> Column:
    """The first field, in model order, whose value the model cannot take."""
    problem = F.lit(None).cast("string")
    checks: list[tuple[Column, str]] = []
    for feature in model.features:
        if feature not in df.columns:
            checks.append((F.lit(True), f"{MISSING}:{feature}"))
            continue
        checks.append((F.col(feature).isNull(), f"{NULL}:{feature}"))
        if feature in model.category_features:
            checks.append((F.col(_WEIGHT.format(feature)).isNull(), f"{UNSEEN}:{feature}"))
        else:
            number = F.col(_NUMBER.format(feature))
            checks.append((number.isNull() | F.isnan(number), f"{BAD_TYPE}:{feature}"))
    for failed, reason in reversed(checks):
        problem = F.when(failed, reason).otherwise(problem)
    return problem


def prepare(df: DataFrame, model) -> DataFrame:
    """Check every model input of every row: adds ``status``, ``failure_reason``
    and ``failed_field``, and keeps bad rows instead of dropping or raising."""
    return _prepared(df, model).drop(*_helper_columns(model))


def _helper_columns(model) -> list[str]:
    inputs = [(_WEIGHT if f in model.category_features else _NUMBER).format(f) for f in model.features]
    return [*inputs, _PROBLEM, _MARGIN]


def _prepared(df: DataFrame, model) -> DataFrame:
    ready = _attach_inputs(df, model).withColumn(_PROBLEM, _first_problem(df, model))
    problem = F.col(_PROBLEM)
    return ready.withColumns(
        {
            "status": F.when(problem.isNull(), OK).otherwise(FAILURE),
            "failure_reason": F.substring_index(problem, ":", 1),
            "failed_field": F.substring(problem, F.locate(":", problem) + 1, F.length(problem)),
            _MARGIN: F.when(problem.isNull(), margin(model, set(df.columns))),
        }
    )


def margin(model, present: Container[str]) -> Column:
    """Intercept plus the weighted inputs, added up in model order."""
    total = F.lit(float(model.intercept))
    for feature in model.features:
        if feature not in present:
            term = F.lit(None).cast("double")
        elif feature in model.category_features:
            term = F.col(_WEIGHT.format(feature))
        else:
            term = F.lit(float(model.numeric_weights[feature])) * F.col(_NUMBER.format(feature))
        total = total + term
    return total


def score(df: DataFrame, model) -> DataFrame:
    """Score every row.

    Adds ``status``, ``failure_reason``, ``failed_field``, ``prediction``,
    ``probability_0``, ``probability_1``, ``to_filter`` and ``precision``; the
    last five are null where the status is a failure. ``to_filter`` is not
    gated by any threshold.
    """
    p1, p0 = F.col("probability_1"), F.col("probability_0")
    prediction = F.col("prediction")
    return (
        _prepared(df, model)
        .withColumn("probability_1", logistic.positive_probability(F.col(_MARGIN)))
        .withColumns({"probability_0": F.lit(1.0) - p1, "prediction": logistic.predicted_class(p1)})
        .withColumns(
            {
                "to_filter": logistic.is_filtered_class(prediction),
                "precision": F.when(prediction.isNotNull(), logistic.class_confidence(prediction, p0, p1)),
            }
        )
        .drop(*_helper_columns(model))
    )


def prediction_struct(features_id: Column, prediction: Column, precision: Column) -> Column:
    """A prediction record from a model class (0.0 = filter) and its confidence."""
    return F.struct(
        features_id.alias("features_id"),
        logistic.is_filtered_class(prediction).alias("to_filter"),
        precision.alias("precision"),
    )


def with_prediction(scored: DataFrame, id_column: str = "featuresId", default: bool = False) -> DataFrame:
    """Add the ``result`` record; with ``default`` a failure yields ``NO_PREDICTION``."""
    made = F.when(
        F.col("status") == OK,
        prediction_struct(F.col(id_column).cast("string"), F.col("prediction"), F.col("precision")),
    )
    if default:
        fallback = F.struct(*[F.lit(value).alias(name) for name, value in NO_PREDICTION.items()])
        made = F.coalesce(made, fallback)
    return scored.withColumn("result", made)


def prediction_csv(to_filter: Column, precision: Column) -> Column:
    """``true,0.731059``: fixed six places, so the text is the same on every engine."""
    return F.concat_ws(",", to_filter.cast("string"), precision.try_cast("decimal(18,6)").cast("string"))


def gated(threshold: float | None) -> Column:
    """The filter decision that counts: class says filter and confidence reaches the gate."""
    ok = F.col("status") == OK
    decision = ok & F.col("to_filter")
    if threshold is not None and float(threshold) != -1.0:
        decision = decision & (F.col("precision") >= float(threshold))
    return F.coalesce(decision, F.lit(False))


def with_gate(scored: DataFrame, threshold: float | None) -> DataFrame:
    return scored.withColumn("filtered", gated(threshold))


def route(scored: DataFrame, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, filtered)``: failed rows are kept, since nothing was predicted for them."""
    decided = with_gate(scored, threshold)
    return decided.filter(~F.col("filtered")), decided.filter(F.col("filtered"))
