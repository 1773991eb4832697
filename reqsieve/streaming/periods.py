"""One report per period: counters are collected while a period runs, reported once, and reset.

Each monitor and period is a key with state: its sums so far. An event-time timer ends the
period; its report goes out and only the mark that it did stays, until a second timer
clears that too. State is bounded by the periods within ``delay`` and ``remember`` of the
stream's clock (its watermark).

    final        the one report of a period
    correction   what events add that came after it
    no time      what events without a time add; they are in no period, and go out at once

Reports and the periods still open (``open_periods``) add up to the counters of the batch
operator. Events are added up by each task before they are shuffled, so a hot monitor
sends one row per task and period to its state.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reqsieve.functions.periods import period_millis
from reqsieve.operators.counters import MICROS, counter_sums, event_deltas, present, window_start
from reqsieve.schemas import COUNTERS
from reqsieve.session import written_folders
from reqsieve.sources.sinks import Sink, no_sink

FINAL, CORRECTION, NO_TIME = "final", "correction", "no time"
SUMS = (*COUNTERS, MICROS)
#: Rows that a task adds up before it hands them on.
COMBINED_ROWS = 100_000
# State is kept under keys without nulls: the window's start, or this, and the group as JSON.
_WINDOW, _GROUP, _NO_WINDOW = "window_ms", "group_json", int(np.iinfo(np.int64).min)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _added(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Rows added up by key; a null key is a key of its own."""
    summed = table.group_by(list(keys)).aggregate([(c, "sum") for c in SUMS])
    return summed.select([*keys, *(f"{c}_sum" for c in SUMS)]).rename_columns([*keys, *SUMS])


def partial_counters(scored: DataFrame, period: str, ts: str, by: Sequence[str], threshold: float | None, rows: int = COMBINED_ROWS) -> DataFrame:
    """Counters of each task's own events per window and group, for a later sum over all tasks."""
    window = F.coalesce(F.unix_millis(window_start(F.col(ts), period)), F.lit(_NO_WINDOW)).alias(_WINDOW)
    group = (F.to_json(F.struct(*by)) if by else F.lit("{}")).alias(_GROUP)
    events = scored.select(window, group, *[value.alias(name) for name, value in event_deltas(threshold).items()])
    keys = [_WINDOW, _GROUP]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_added(pa.Table.from_batches([batch]), keys))
            size += len(held[-1])
            if size > rows:
                held = [_added(pa.concat_tables(held), keys)]
                size = len(held[0])
                if size > rows // 2:  # most keys are new ones: hand on what there is
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _added(pa.concat_tables(held), keys).to_batches()

    return events.mapInArrow(task, events.schema)


class PeriodReports(StatefulProcessor):
    """State of one window of one group: its sums, and whether they have been reported."""

    def __init__(self, period_ms: int, remember_ms: int):
        self.period, self.remember = period_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sums", ", ".join(f"{c} long" for c in SUMS) + ", reported boolean")

    def _row(self, key: tuple, kind: str, sums: Sequence[int]) -> pd.DataFrame:
        return pd.DataFrame({_WINDOW: [int(key[0])], _GROUP: [key[1]], "kind": [kind], **{c: [s] for c, s in zip(SUMS, sums)}})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = [0] * len(SUMS)
        for part in rows:
            sums = [s + int(part[c].sum()) for s, c in zip(sums, SUMS)]
        if int(key[0]) == _NO_WINDOW:
            yield self._row(key, NO_TIME, sums)
            return
        end, now = int(key[0]) + self.period, timerValues.getCurrentWatermarkInMs()
        known = self.state.get() if self.state.exists() else None
        if known is None and end + self.remember <= now:
            yield self._row(key, CORRECTION, sums)  # whether it was reported is forgotten: it had the time to be
        elif known is not None and known[-1]:
            yield self._row(key, CORRECTION, sums)
        elif known is None and end <= now:  # all of its events came late: this is its report
            yield self._report(key, sums, end)
        else:
            if known is None:
                self.handle.registerTimer(end)
            else:
                sums = [s + int(k) for s, k in zip(sums, known)]
            self.state.update((*sums, False))

    def _report(self, key: tuple, sums: Sequence[int], end: int) -> pd.DataFrame:
        self.state.update((*[0] * len(SUMS), True))
        self.handle.registerTimer(end + self.remember)
        return self._row(key, FINAL, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        if known is not None and not known[-1]:
            yield self._report(key, [int(k) for k in known[:-1]], int(key[0]) + self.period)
        elif known is not None:
            self.state.clear()

    def close(self) -> None:
        pass


def start_periods(
    scored: DataFrame,
    out: str,
    checkpoint: str,
    period: str = "PT30S",
    by: Sequence[str] = (),
    threshold: float | None = 0.7,
    ts: str = "ts",
    delay: str = "PT30S",
    remember: str = "P1D",
    sink: Sink = no_sink,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Report each period of a stream of scored requests once, ``delay`` after its end in event time.

    Rows ``(window_start, *by, kind, counters)`` of each micro-batch go to
    ``<out>/batch_id=<n>``, which a repeated batch overwrites, and to ``sink`` in presented form.
    Later events are corrections; no event is lost. Whether a period was reported is
    remembered for ``remember`` after its end; events later than that are corrections.
    """
    spark = scored.sparkSession
    timed = scored.withWatermark(ts, f"{period_millis(delay)} milliseconds")
    parts = partial_counters(timed, period, ts, by, threshold)
    shape = f"{_WINDOW} long, {_GROUP} string, kind string, " + ", ".join(f"{c} long" for c in SUMS)
    groups = T.StructType([scored.schema[c] for c in by])
    processor = PeriodReports(period_millis(period), period_millis(remember))
    reports = parts.groupBy(_WINDOW, _GROUP).transformWithStateInPandas(processor, shape, "append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch_id={batch_id}"
        rows = _named(batch, groups)
        rows.write.mode("overwrite").parquet(path)
        if sink is not no_sink:
            sink(present(batch.sparkSession.read.schema(rows.schema).parquet(path)), batch_id)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # what keeps timers; a query takes its settings when it starts
    try:
        writer = reports.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
        return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _named(rows: DataFrame, groups: T.StructType) -> DataFrame:
    """Keys as they were: the start of the window and the group's columns."""
    named: list[Column] = [F.timestamp_millis(F.when(F.col(_WINDOW) != _NO_WINDOW, F.col(_WINDOW))).alias("window_start")]
    if groups.fields:
        group = F.from_json(_GROUP, groups)
        named += [group[f.name].alias(f.name) for f in groups.fields]
    return rows.select(*named, *[c for c in rows.columns if c not in (_WINDOW, _GROUP)])


def period_reports(spark: SparkSession, out: str) -> DataFrame:
    """Every report and correction so far, in additive form."""
    names = [n for n in written_folders(spark, out) if n.startswith("batch_id=")]
    if not names:
        raise LookupError(f"no batch has been counted under {out}")
    shape = spark.read.parquet(f"{out}/{names[0]}").schema
    return spark.read.schema(shape).parquet(*[f"{out}/{n}" for n in names])


def open_periods(spark: SparkSession, checkpoint: str, groups: T.StructType | str) -> DataFrame:
    """The periods of a stopped stream that were not reported yet, from its state: ``(window_start, *by, counters)``.

    ``groups`` is the schema of the ``by`` columns.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "sums").load()
    rows = state.filter("NOT value.reported").select(f"key.{_WINDOW}", f"key.{_GROUP}", *[F.col(f"value.{c}").alias(c) for c in SUMS])
    return _named(rows, T.StructType.fromDDL(groups) if isinstance(groups, str) else groups)


def settled(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reports and corrections added up per period, in additive form."""
    return reports.groupBy("window_start", *by).agg(*counter_sums())
