"""Category vocabularies as tables: any number of categories, no driver involved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.session import cut_lineage
from reqsieve.sizing import join_side


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, category, frequency)`` of several columns from one scan.

    Counts are combined per task before the shuffle, so a category with a third
    of all rows is one row per task.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns]
    flat = df.select(F.inline(F.array(*pairs))).filter(F.col("category").isNotNull())
    return flat.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("frequency"))


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, category, frequency, idx)``: idx counts from 0 by falling
    frequency, ties in text order.

    A row number over the whole list would put it into one task. Instead the
    list is range-partitioned and sorted, written once, and each partition is
    shifted by the sizes of the ones before it.
    """
    order = [F.col("feature"), F.col("frequency").desc(), F.col("category")]
    placed = cut_lineage(
        category_counts(df, columns)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}),
        "vocabulary",
    )
    # One row per partition and feature.
    sizes = placed.groupBy("feature", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("feature", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return placed.join(join_side(shifts), ["feature", "part"]).select(
        "feature", "category", "frequency", (F.col("shift") + F.col("place") - F.col("first")).alias("idx")
    )


def sizes(vocabulary: DataFrame) -> dict[str, tuple[int, int]]:
    """Categories of each feature and the bytes they take in a join, from one job over a
    written vocabulary."""
    width = F.octet_length("category") + 2 * 8
    counted = vocabulary.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    return {r.feature: (r.n, r.bytes) for r in counted.collect()}  # one row per feature


def attach_index(df: DataFrame, vocabulary: DataFrame, column: str, output: str, known_bytes: int | None = None) -> DataFrame:
    """Index of each row's category; rows with an unseen category are left out.

    A list counted small (by the caller, where ``known_bytes`` is given) is broadcast.
    A larger one is a shuffle join, where AQE splits the partition of a hot category.
    """
    side = vocabulary.filter(F.col("feature") == column).select(
        F.col("category").alias("__category"), F.col("idx").cast("double").alias(output)
    )
    return df.join(join_side(side, known_bytes=known_bytes), F.col(column).cast("string") == F.col("__category")).drop("__category")
