"""The six quality counters: totals, windows, roll-ups, report rows.

Every aggregate here is built from counts and sums, so Spark combines on the
map side and a hot monitor or window costs one partial row per task. The
confidence sum is kept as whole millionths in a BIGINT: exact in any order of
addition, so retries and different partitionings cannot change a report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.periods import period_millis
from reqsieve.operators.score import FAILURE, OK, gated
from reqsieve.schemas import COUNTERS

MICROS = "precision_micros"

# Report name of each counter.
METRIC_NAMES = {
    "input": "Request-Histogram",
    "filtered": "FilteredByPrediction-Counter",
    "false_negative": "FalseNegative-Counter",
    "invalid": "EvalFailure-Counter",
    "real_value": "RealAd-Counter",
}
# Field order of a report line; the average confidence comes last.
LOG_LINE_ORDER = ("input", "real_value", "filtered", "false_negative", "invalid")


def micros(precision: Column) -> Column:
    """A confidence in whole millionths."""
    return F.floor(precision * 1_000_000 + 0.5).cast("bigint")


def event_deltas(threshold: float | None, real: str = "real_positive") -> dict[str, Column]:
    """What one scored event adds to each counter."""
    ok = F.col("status") == OK
    positive = F.coalesce(F.col(real), F.lit(False))
    filtered = gated(threshold)
    return {
        "input": F.lit(1).cast("bigint"),
        "filtered": filtered.cast("bigint"),
        "false_negative": (filtered & positive).cast("bigint"),
        "invalid": (F.col("status") == FAILURE).cast("bigint"),
        "real_value": positive.cast("bigint"),
        MICROS: F.coalesce(F.when(ok, micros(F.col("precision"))), F.lit(0).cast("bigint")),
    }


def counter_sums(names: Sequence[str] = (*COUNTERS, MICROS)) -> list[Column]:
    return [F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in names]


def aggregate_counters(
    scored: DataFrame, by: Sequence[Column | str] = (), threshold: float | None = 0.7, real: str = "real_positive"
) -> DataFrame:
    """Counters per group in additive form (``precision_micros``), ready to merge."""
    deltas = event_deltas(threshold, real)
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    events = scored.select(*keys, *[value.alias(name) for name, value in deltas.items()])
    names = [c for c in events.columns if c not in deltas]
    return events.groupBy(*names).agg(*counter_sums())


def present(counters: DataFrame) -> DataFrame:
    """Replace the additive sum by ``precision_sum`` and ``avg_precision``.

    The average divides by the input count, failures included.
    """
    total = F.col(MICROS) / F.lit(1_000_000.0)
    return counters.withColumns(
        {"precision_sum": total, "avg_precision": F.try_divide(total, F.col("input"))}
    ).drop(MICROS)


def count_total(scored: DataFrame, by: Sequence[str] = (), threshold: float | None = 0.7) -> DataFrame:
    return present(aggregate_counters(scored, by, threshold))


def window_start(ts: Column, period: str) -> Column:
    """Start of the tumbling window of a moment, counted from 1970; null for a null moment."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(period_millis(period) * 1000)))


def window_counters(
    scored: DataFrame, period: str = "PT30S", ts: str = "ts", by: Sequence[str] = (), threshold: float | None = 0.7
) -> DataFrame:
    """Tumbling windows in additive form.

    Events without a time are counted under a null ``window_start``, so the
    windows always add up to the total.
    """
    return aggregate_counters(scored, [window_start(F.col(ts), period).alias("window_start"), *by], threshold)


def merge_counters(parts: DataFrame, by: Sequence[Column | str] = (), compat: bool = False) -> DataFrame:
    """Add up partial counter rows (hours to days, task parts to a total).

    ``compat`` takes the merged input count from ``real_value``, a known slip
    of the original merge.
    """
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    names = parts.select(*keys).columns if keys else []
    rows = parts.select(
        *keys,
        (F.col("real_value") if compat else F.col("input")).alias("input"),
        *[F.col(c) for c in (*COUNTERS[1:], MICROS)],
    )
    return rows.groupBy(*names).agg(*counter_sums())


def metric_rows(counters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One ``(metric, value)`` row per named counter; the average has no name."""
    named = counters.select(*keys, *[F.col(c).alias(METRIC_NAMES[c]) for c in COUNTERS])
    return named.unpivot(list(keys), list(METRIC_NAMES.values()), "metric", "value")


def log_line() -> Column:
    """The report line of a presented counter row."""
    average = F.coalesce(F.col("avg_precision").try_cast("decimal(18,6)").cast("string"), F.lit("NaN"))
    return F.concat_ws(",", *[F.col(c).cast("string") for c in LOG_LINE_ORDER], average)


def log_lines(counters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counters.select(*keys, log_line().alias("line"))


def keyed_log_lines(counters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report lines that say what they are about: ``window_start=...,monitor_id=...,`` and the counters."""
    named = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    return counters.select(F.concat_ws(",", *named, log_line()).alias("line"))
