"""The binary logistic model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def predicted_class(p1: Column) -> Column:
    """1.0 above one half; an exact tie is class 0."""
    return F.when(p1 > 0.5, 1.0).when(p1 <= 0.5, 0.0)


def is_filtered_class(prediction: Column) -> Column:
    """Class 0 marks a request as not relevant."""
    return prediction == 0.0


def class_confidence(prediction: Column, p0: Column, p1: Column) -> Column:
    return F.when(prediction == 0.0, p0).otherwise(p1)
