"""How good the filtering was, from a labelled and scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.operators.score import FAILURE


def confusion_matrix(scored: DataFrame, real: str = "real_positive", predicted: str = "filtered") -> DataFrame:
    """Count of each (real, predicted) pair among the rows that were scored."""
    return (
        scored.filter(F.col("status") != FAILURE)
        .groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def area_under_roc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """``positives``, ``negatives`` and the exact ``area_under_roc`` (null without either), one row.

    The share of pairs of a positive and a negative row in which the positive one
    scores higher; ties count half. Rows are first counted per distinct score. The
    scores are then range-sorted, and each partition counts from the negatives of
    the partitions before it, so no task sees more than its own scores.
    """
    hit = F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")
    counts = scored.groupBy(F.col(score).alias("score")).agg(*hit).repartitionByRange("score")
    placed = counts.withColumn("part", F.spark_partition_id())
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    below = placed.withColumn("below", F.coalesce(inside, F.lit(0)))
    own = below.groupBy("part").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won")
    )
    # one row per partition from here on
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    summed = own.withColumn("earlier", F.coalesce(earlier, F.lit(0))).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"),
        F.sum(F.col("won") + F.col("p") * F.col("earlier")).alias("won"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return summed.select("positives", "negatives", F.try_divide("won", pairs).alias("area_under_roc"))


def quality(scored: DataFrame, real: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision and recall of ``predicted`` against ``real``, in one pass.

    ``coverage`` is the share of rows that could be scored at all.
    """
    ok = F.col("status") != FAILURE
    hit, said = F.col(real), F.col(predicted)
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_scored"),
        F.count_if(ok & hit & said).alias("true_positive"),
        F.count_if(ok & ~hit & said).alias("false_positive"),
        F.count_if(ok & hit & ~said).alias("false_negative"),
        F.count_if(ok & ~hit & ~said).alias("true_negative"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return counts.withColumns(
        {
            "coverage": F.try_divide(F.col("n_scored"), F.col("n_rows")),
            "accuracy": F.try_divide(tp + tn, F.col("n_scored")),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
        }
    )
