"""Models of several dates, scored in one scan: every coefficient is an array with one entry per date.

A category's array is looked up once, whatever the number of dates; a request's margins are
the arrays added up entry by entry. ``score_as_of`` takes the one entry that was in force at the
request's time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions import logistic
from reqsieve.functions.parsing import parse_double
from reqsieve.operators.score import FAILURE, OK
from reqsieve.plans.portable import CATEGORY, INTERCEPT, NUMERIC
from reqsieve.schemas import COEFFICIENTS
from reqsieve.sizing import join_side
from reqsieve.sources.model_store import coefficients_path

NO_MODEL = "no_model"


@dataclass(frozen=True)
class DatedModels:
    """``dates`` in ascending order; what belongs to a date stands at its place in each array.

    ``uses`` tells which dates' models take a feature; the others neither add nor check it.
    """

    dates: Sequence[str]
    intercepts: Sequence[float]
    numeric_weights: Mapping[str, Sequence[float]]
    categories: Mapping[str, DataFrame]  # (category, weights)
    uses: Mapping[str, Sequence[bool]]

    @classmethod
    def from_table(cls, table: DataFrame, dates: Sequence[str]) -> DatedModels:
        """Read the models of these dates; each must be there once."""
        dates = sorted(set(dates))
        wanted = table.filter(F.col("model_date").isin(list(dates)))
        names = F.count_distinct(F.coalesce("category", F.lit("")))
        found = wanted.groupBy("model_date", "feature", "kind").agg(F.count(F.lit(1)).alias("n"), names.alias("names"), F.first("coefficient").alias("w"))
        rows = found.collect()  # one row per date and feature
        missing = set(dates) - {r.model_date for r in rows if r.kind == INTERCEPT and r.n == 1}
        if missing or any(r.n != r.names for r in rows):
            raise LookupError(f"no single model of {', '.join(sorted(missing)) or 'each date'}")
        at = {d: k for k, d in enumerate(dates)}
        uses: dict[str, list[bool]] = {r.feature: [False] * len(dates) for r in sorted(rows, key=lambda r: r.feature) if r.kind != INTERCEPT}
        numbers: dict[str, list[float]] = {r.feature: [0.0] * len(dates) for r in rows if r.kind == NUMERIC}
        intercepts = [0.0] * len(dates)
        for r in rows:
            if r.kind == INTERCEPT:
                intercepts[at[r.model_date]] = r.w
                continue
            uses[r.feature][at[r.model_date]] = True
            if r.kind == NUMERIC:
                numbers[r.feature][at[r.model_date]] = r.w
        weights = F.array(*[F.max(F.when(F.col("model_date") == d, F.col("coefficient"))) for d in dates])
        categories = {}
        for feature in sorted({r.feature for r in rows if r.kind == CATEGORY}):
            entries = wanted.filter((F.col("kind") == CATEGORY) & (F.col("feature") == feature))
            categories[feature] = join_side(entries.groupBy("category").agg(weights.alias("weights")))
        return cls(dates, intercepts, numbers, categories, uses)


def load_dated(spark: SparkSession, base: str, dates: Sequence[str]) -> DatedModels:
    """Published models of several dates; only their folders are read."""
    return DatedModels.from_table(spark.read.schema(COEFFICIENTS).parquet(coefficients_path(base)), dates)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _scaled(weights: Sequence[float], number: Column) -> Column:
    return F.transform(_numbers(weights), lambda w: w * number)


def _terms(rows: DataFrame, models: DatedModels) -> tuple[DataFrame, list[Column]]:
    """Per feature an array: what it adds to the margin of each date, null where the value is no input of that model."""
    terms = []
    for feature, used in models.uses.items():
        if feature not in rows.columns:
            value = F.array(*[F.lit(None).cast("double")] * len(models.dates))
        elif feature in models.categories:
            side = models.categories[feature].select(F.col("category").alias(f"__k_{feature}"), F.col("weights").alias(f"__w_{feature}"))
            rows = rows.join(side, F.col(feature).cast("string") == F.col(f"__k_{feature}"), "left").drop(f"__k_{feature}")
            # an unseen category has no array, a category that some models know has gaps
            value = F.coalesce(F.col(f"__w_{feature}"), F.array(*[F.lit(None).cast("double")] * len(models.dates)))
        else:
            number = parse_double(F.col(feature)) if rows.schema[feature].dataType.typeName() == "string" else F.col(feature).cast("double")
            value = _scaled(models.numeric_weights[feature], F.when(~F.isnan(number), number))
        if not all(used):
            value = F.zip_with(value, F.array(*[F.lit(u) for u in used]), lambda x, u: F.when(u, x).otherwise(0.0))
        terms.append(value)
    return rows, terms


def _decided(margin: Column) -> dict[str, Column]:
    p1 = logistic.positive_probability(margin)
    prediction = logistic.predicted_class(p1)
    return {
        "status": F.when(margin.isNotNull(), OK).otherwise(FAILURE),
        "prediction": prediction,
        "probability_1": p1,
        "to_filter": logistic.is_filtered_class(prediction),
        "precision": F.when(prediction.isNotNull(), logistic.class_confidence(prediction, F.lit(1.0) - p1, p1)),
    }


_HELPERS = ("__margins", "__margin", "__date")


def _helpers(models: DatedModels) -> list[str]:
    return [*_HELPERS, *[f"__w_{f}" for f in models.categories]]


def score_by_date(rows: DataFrame, models: DatedModels) -> DataFrame:
    """One row per row and date, with ``model_date``, ``status``, ``prediction``, ``probability_1``,
    ``to_filter`` and ``precision``; the rows are read once."""
    rows, terms = _terms(rows, models)
    margins = _numbers(models.intercepts)
    for term in terms:
        margins = F.zip_with(margins, term, lambda m, t: m + t)
    names = F.array(*[F.lit(d) for d in models.dates])
    dated = rows.select("*", F.explode(F.arrays_zip(names.alias("model_date"), margins.alias("margin"))).alias("__margins"))
    return dated.withColumns({"model_date": F.col("__margins.model_date"), **_decided(F.col("__margins.margin"))}).drop(*_helpers(models))


def score_as_of(rows: DataFrame, models: DatedModels, ts: str = "ts") -> DataFrame:
    """Each row scored by the latest model whose date is not after the row's own (UTC).

    A row before every model, or without a time, fails; its ``model_date`` is null.
    """
    day = F.date_format(F.col(ts).cast("timestamp"), "yyyyMMdd")
    place = sum(((day >= d).cast("int") for d in models.dates), F.lit(0))
    rows, terms = _terms(rows, models)
    at = F.coalesce(place, F.lit(0)) - 1
    margin = F.get(_numbers(models.intercepts), at)
    for term in terms:
        margin = margin + F.get(term, at)
    chosen = F.get(F.array(*[F.lit(d) for d in models.dates]), at)
    return rows.withColumns({"__margin": margin, "__date": chosen}).withColumns(
        {"model_date": F.col("__date"), **_decided(F.col("__margin")), "failure_reason": F.when(F.col("__date").isNull(), NO_MODEL)}
    ).drop(*_helpers(models))
