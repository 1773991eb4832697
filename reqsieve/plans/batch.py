"""Whole jobs: score a table, and report how the filtering did."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.config import EngineConfig
from reqsieve.operators import counters
from reqsieve.operators.normalize import normalize_prediction, normalize_training, real_positive
from reqsieve.operators.score import score, with_gate
from reqsieve.schemas import LABEL

FILTERED = "filtered"


def score_labelled(
    requests: DataFrame,
    model,
    keep: Sequence[str] = (),
    label: str = LABEL,
    outcome: Callable[[str], Column] = real_positive,
) -> DataFrame:
    """Score requests that carry their true label.

    Labelled rows use the training rules; ``outcome`` turns the label column
    into the boolean ``real_positive``.
    """
    rows = normalize_training(requests, label=label, keep=keep)
    return score(rows, model).withColumn("real_positive", outcome(LABEL))


def score_unlabelled(requests: DataFrame, model, keep: Sequence[str] = ()) -> DataFrame:
    return score(normalize_prediction(requests, keep=keep), model)


def score_and_monitor(requests: DataFrame, model, config: EngineConfig | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The six counters of a labelled table, per ``by`` group."""
    config = config or EngineConfig()
    scored = score_labelled(requests, model, keep=by)
    return counters.count_total(scored, by, config.threshold)


def decide(requests: DataFrame, model, config: EngineConfig | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Unlabelled requests with the gated ``filtered`` decision added."""
    config = config or EngineConfig()
    return with_gate(score_unlabelled(requests, model, keep), config.threshold)


def write_counted(scored: DataFrame, path: str, threshold: float | None = 0.7, route: bool = False) -> DataFrame:
    """Write scored requests, and count the very results that were written: one scan and one scoring.

    Returns the six counters of the written rows, one row. With ``route`` kept and filtered
    requests go to folders of their own, read by ``read_route``. The counts come from the written
    table's few columns of results. (Observed metrics would save that look, but in Spark 4.1 they leave a
    listener in the session with which no Spark ML model can be sent to executors any more.)
    """
    decided = with_gate(scored, threshold)
    writer = decided.write.mode("overwrite")
    (writer.partitionBy(FILTERED) if route else writer).parquet(path)
    return counters.count_total(scored.sparkSession.read.schema(decided.schema).parquet(path), threshold=threshold)


def read_route(spark: SparkSession, path: str, filtered: bool) -> DataFrame:
    """The kept or the filtered requests of ``write_counted``; only their folder is read."""
    stored = spark.read.parquet(path)
    return stored.filter(F.col(FILTERED).cast("boolean") == filtered)


def score_with_counters(
    requests: DataFrame, model, path: str, config: EngineConfig | None = None, keep: Sequence[str] = (), route: bool = False
) -> DataFrame:
    """Score labelled requests into a table and count the very results that are written."""
    config = config or EngineConfig()
    return write_counted(score_labelled(requests, model, keep), path, config.threshold, route)
