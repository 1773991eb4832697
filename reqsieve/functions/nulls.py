"""Rules for texts that mean "not available"."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, and per raw column the texts (besides null) it replaces.
NOT_AVAILABLE = "NA"
TRAINING_RULES: Mapping[str, tuple[str, ...]] = {
    "publisherId": ("",),
    "country": ("",),
    "gender": ("null",),
    "brand": ("",),
    "connectionType": (),
}
PREDICTION_RULES: Mapping[str, tuple[str, ...]] = {
    "publisherId": ("",),
    "country": ("",),
    "gender": (),
    "brand": ("",),
    "connectionType": ("(null)",),
}
# Numbers standing in for an absent field, prediction only.
PREDICTION_DEFAULTS: Mapping[str, int | float] = {"age": -1, "rtbFloorSent": 0.0}


def na_text(text: Column, tokens: Iterable[str] = ()) -> Column:
    """null and any of ``tokens`` become ``'NA'``; blanks are not trimmed."""
    tokens = list(tokens)
    if not tokens:
        return F.coalesce(text, F.lit(NOT_AVAILABLE))
    return F.when(text.isNull() | text.isin(tokens), NOT_AVAILABLE).otherwise(text)


def merged_rules(*rules: Mapping[str, Iterable[str]]) -> dict[str, tuple[str, ...]]:
    """Union of the tokens of several rule sets, column by column."""
    merged: dict[str, dict[str, None]] = {}
    for rule in rules:
        for column, tokens in rule.items():
            merged.setdefault(column, {}).update(dict.fromkeys(tokens))
    return {column: tuple(tokens) for column, tokens in merged.items()}
