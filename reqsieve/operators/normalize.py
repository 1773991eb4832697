"""Raw requests to model features, one ``select`` per mode."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.identity import features_id
from reqsieve.functions.nulls import PREDICTION_DEFAULTS, PREDICTION_RULES, TRAINING_RULES, merged_rules, na_text
from reqsieve.schemas import LABEL, NORMALIZED

Rules = Mapping[str, Iterable[str]]

# Model column -> raw column it is read from, where they differ.
RENAMES = {"conType": "connectionType", "withGeo": "withGeoInfo", "rtbFloorPriceSent": "rtbFloorSent"}


def _feature_columns(rules: Rules, defaults: Mapping[str, int | float]) -> dict[str, Column]:
    columns = {}
    for field in NORMALIZED.fields:
        if field.name == "featuresId":
            continue
        raw = RENAMES.get(field.name, field.name)
        value = F.col(raw).cast(field.dataType)
        if raw in rules:
            value = na_text(value, rules[raw])
        if raw in defaults:
            value = F.coalesce(value, F.lit(defaults[raw]).cast(field.dataType))
        columns[field.name] = value
    return columns


def _select(df: DataFrame, features: Mapping[str, Column], label: Column | None, keep: Sequence[str], id_method: str) -> DataFrame:
    out = [F.col(c) for c in keep]
    out += [value.alias(name) for name, value in features.items()]
    out.append(features_id(method=id_method).alias("featuresId"))
    if label is not None:
        out.append(label.alias(LABEL))
    return df.select(*out)


def _rules(own: Rules, given: Rules | None, unified: bool) -> Rules:
    if given is not None:
        return given
    return merged_rules(TRAINING_RULES, PREDICTION_RULES) if unified else own


def normalize_training(
    df: DataFrame,
    *,
    label: Column | str = LABEL,
    keep: Sequence[str] = (),
    rules: Rules | None = None,
    unified: bool = False,
    id_method: str = "md5",
) -> DataFrame:
    """Twelve features plus the label as 0.0 / 1.0.

    ``keep`` carries further columns along, ``rules`` replaces the built-in
    null rules, ``unified`` applies the training and prediction rules together.
    """
    label = F.col(label) if isinstance(label, str) else label
    features = _feature_columns(_rules(TRAINING_RULES, rules, unified), {})
    return _select(df, features, label.cast("double"), keep, id_method)


def normalize_prediction(
    df: DataFrame,
    *,
    keep: Sequence[str] = (),
    rules: Rules | None = None,
    defaults: Mapping[str, int | float] = PREDICTION_DEFAULTS,
    unified: bool = False,
    id_method: str = "md5",
) -> DataFrame:
    """Twelve features of an unlabelled request; absent age and floor get defaults."""
    features = _feature_columns(_rules(PREDICTION_RULES, rules, unified), defaults)
    return _select(df, features, None, keep, id_method)


def normalize_mixed(df: DataFrame, *, label: str = LABEL, keep: Sequence[str] = (), id_method: str = "md5") -> DataFrame:
    """Training rules where the label is present, prediction rules where it is null."""
    training = _feature_columns(TRAINING_RULES, {})
    prediction = _feature_columns(PREDICTION_RULES, PREDICTION_DEFAULTS)
    differing = {
        name
        for name in training
        for raw in [RENAMES.get(name, name)]
        if raw in PREDICTION_DEFAULTS or set(TRAINING_RULES.get(raw, ())) != set(PREDICTION_RULES.get(raw, ()))
    }
    labelled = F.col(label).isNotNull()
    features = {
        name: F.when(labelled, training[name]).otherwise(prediction[name]) if name in differing else training[name]
        for name in training
    }
    return _select(df, features, F.col(label).cast("double"), keep, id_method)


def feature_struct(with_label: bool = False) -> Column:
    """The named feature record of a normalized row."""
    names = NORMALIZED.fieldNames() + ([LABEL] if with_label else [])
    return F.struct(*[F.col(n) for n in names])


def feature_json(with_label: bool = False) -> Column:
    """The named feature record as JSON text; absent values stay as null entries."""
    return F.to_json(feature_struct(with_label), {"ignoreNullFields": "false"})


def real_positive(label: Column | str = LABEL, win_is_positive: bool = False) -> Column:
    """Label to outcome.

    By default a winning request (1.0) is the negative outcome and everything
    else positive; ``win_is_positive`` gives the opposite polarity. NaN counts
    as "not 1.0".
    """
    label = F.col(label) if isinstance(label, str) else label
    won = label.cast("double") == 1.0
    return won if win_is_positive else ~won
