"""Record shapes shared by the batch and streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column order of a request CSV line (position 0 is unused).
CSV_COLUMNS = (
    "id",
    "country",
    "age",
    "gender",
    "brand",
    "height",
    "width",
    "connectionType",
    "withBundleId",
    "withGeoInfo",
    "publisherId",
    "rtbFloorSent",
    "isWinning",
)

CSV_LINE = T.StructType([T.StructField(name, T.StringType()) for name in CSV_COLUMNS])

RAW_REQUEST = T.StructType(
    [
        T.StructField("publisherId", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("connectionType", T.StringType()),
        T.StructField("withBundleId", T.BooleanType()),
        T.StructField("withGeoInfo", T.BooleanType()),
        T.StructField("rtbFloorSent", T.DoubleType()),
    ]
)

# What the model sees; training rows add isWinning DOUBLE.
NORMALIZED = T.StructType(
    [
        T.StructField("publisherId", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("conType", T.StringType()),
        T.StructField("withBundleId", T.IntegerType()),
        T.StructField("withGeo", T.IntegerType()),
        T.StructField("rtbFloorPriceSent", T.DoubleType()),
        T.StructField("featuresId", T.StringType()),
    ]
)

COEFFICIENTS = T.StructType(
    [
        T.StructField("model_date", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("coefficient", T.DoubleType()),
    ]
)

LABEL = "isWinning"
COUNTERS = ("input", "filtered", "false_negative", "invalid", "real_value")


def schema_problems(df, declared: T.StructType) -> list[tuple[str, str, str | None]]:
    """``(field, declared type, found type)`` of each declared field that ``df`` lacks (found
    None) or has with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [
        (f.name, f.dataType.simpleString(), have[f.name].simpleString() if f.name in have else None)
        for f in declared.fields
        if have.get(f.name) != f.dataType
    ]


def _types_fit(df: DataFrame, declared: T.StructType) -> None:
    problems = [
        f"{name}: declared {wanted}, " + (f"found {found}" if found else "missing") for name, wanted, found in schema_problems(df, declared)
    ]
    if problems:
        raise ValueError("input does not match the declared model schema: " + "; ".join(problems))


def not_null_fields(declared: T.StructType) -> list[str]:
    return [f.name for f in declared.fields if not f.nullable]


def null_fields(names: Sequence[str]) -> Column:
    """Which of the fields are null in a row, in their order."""
    return F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNull(), n) for n in names])) if names else F.array().cast("array<string>")


def null_profile(df: DataFrame, declared: T.StructType) -> DataFrame:
    """``(field, n_rows, n_null)`` of every declared field that ``df`` has, from one aggregate."""
    names = [f.name for f in declared.fields if f.name in df.columns]
    counts = [F.count_if(F.col(f"`{n}`").isNull()).alias(f"c{k}") for k, n in enumerate(names)]
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    entries = [F.struct(F.lit(n).alias("field"), F.col(f"c{k}").alias("n_null")) for k, n in enumerate(names)]
    return totals.select("n_rows", F.inline(F.array(*entries))).select("field", "n_rows", "n_null") if names else totals.select(
        F.lit(None).cast("string").alias("field"), "n_rows", F.lit(0).cast("long").alias("n_null")
    ).limit(0)


def conforming(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The rows without a null in a field declared NOT NULL. Raises if a declared field is missing or of another type."""
    _types_fit(df, declared)
    return df.filter(F.size(null_fields(not_null_fields(declared))) == 0)


def null_rejects(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The other rows, with the fields that are null against the declaration in ``null_fields``."""
    _types_fit(df, declared)
    marked = df.withColumn("null_fields", null_fields(not_null_fields(declared)))
    return marked.filter(F.size("null_fields") > 0)


def check_declared(df: DataFrame, declared: T.StructType, rows: bool = True) -> None:
    """Raise unless ``df`` carries every declared model field with its type, and no null where it is
    declared NOT NULL. ``rows=False`` looks at the types alone and runs no job."""
    _types_fit(df, declared)
    strict = set(not_null_fields(declared))
    open_ = T.StructType([f for f in declared.fields if f.name in strict and df.schema[f.name].nullable])
    if not rows or not open_.fields:
        return
    broken = null_profile(df, open_).filter("n_null > 0").collect()  # one row per field
    if broken:
        raise ValueError("nulls in fields declared NOT NULL: " + "; ".join(f"{r.field}: {r.n_null} of {r.n_rows} rows" for r in broken))
