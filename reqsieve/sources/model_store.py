"""Models by date under one base location.

    <base>/MLModel/<YYYYMMDD>/model/LR            the Spark ML pipeline
    <base>/MLModel/coefficients/model_date=...    the portable coefficients

Any Hadoop URI works as base. A missing model is an error.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.plans.portable import INLINE_CATEGORIES, PortableModel
from reqsieve.schemas import COEFFICIENTS


def _date(model_date: str) -> str:
    if not re.fullmatch(r"\d{8}", model_date):
        raise ValueError(f"model date must be YYYYMMDD, got {model_date!r}")
    return model_date


def pipeline_path(base: str, model_date: str) -> str:
    return f"{base.rstrip('/')}/MLModel/{_date(model_date)}/model/LR"


def coefficients_path(base: str) -> str:
    return f"{base.rstrip('/')}/MLModel/coefficients"


def save_pipeline(model: PipelineModel, base: str, model_date: str) -> str:
    path = pipeline_path(base, model_date)
    model.write().overwrite().save(path)
    return path


def load_pipeline(base: str, model_date: str) -> PipelineModel:
    return PipelineModel.load(pipeline_path(base, model_date))


def publish(coefficients: DataFrame, base: str) -> str:
    """Write the coefficient rows of one or more dates; replaces just those dates."""
    path = coefficients_path(base)
    (
        coefficients.select(*COEFFICIENTS.fieldNames())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_date")
        .parquet(path)
    )
    return path


def coefficients(spark: SparkSession, base: str, model_date: str) -> DataFrame:
    """The rows of one date; only that date's folder is read."""
    table = spark.read.schema(COEFFICIENTS).parquet(coefficients_path(base))
    return table.filter(F.col("model_date") == _date(model_date))


def load_scorer(spark: SparkSession, base: str, model_date: str, inline_limit: int = INLINE_CATEGORIES) -> PortableModel:
    """Read a published model once, to score any number of rows with it."""
    _date(model_date)
    try:
        return PortableModel.from_table(coefficients(spark, base, model_date), inline_limit)
    except (AnalysisException, ValueError) as error:
        raise LookupError(f"no model of {model_date} under {base}: {error}") from error
