"""Where reports go: named metric rows, report lines, predictions, or nowhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.config import EngineConfig
from reqsieve.operators.counters import keyed_log_lines, metric_rows
from reqsieve.operators.score import prediction_csv

Sink = Callable[[DataFrame, int], None]


def report_sink(folder: str, config: EngineConfig, keys: Sequence[str] = ()) -> Sink:
    """A sink for presented counter rows, usable with ``foreachBatch``.

    Named metrics and report lines are switched separately; both carry ``keys``. Each batch writes
    its own folder, so a repeated batch replaces its output instead of adding.
    """

    def write(counters: DataFrame, batch_id: int) -> None:
        if config.metric_monitoring:
            metric_rows(counters, keys).write.mode("overwrite").parquet(f"{folder}/metrics/batch_id={batch_id}")
        if config.send_metric_logging:
            keyed_log_lines(counters, keys).write.mode("overwrite").text(f"{folder}/log/batch_id={batch_id}")

    return write


def no_sink(counters: DataFrame, batch_id: int) -> None:
    """Drops the report without computing it."""


def stored_batch(batch: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """A micro-batch written to its own folder, and read from there: it is computed once for all that follows."""
    path = f"{folder}/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """One ``to_filter,precision`` line per scored request."""
    done = scored.filter(F.col("status") == "ok")
    done.select(prediction_csv(F.col("to_filter"), F.col("precision"))).write.mode("overwrite").text(path)
