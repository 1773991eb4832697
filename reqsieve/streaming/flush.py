"""Flush windows of a stream.

Each micro-batch runs the batch operator on its own rows, starting from the
windows the previous batch left open, and writes closed and open windows of
batch N under ``batch_id=N``. That table is the state: a repeated batch reads
the same predecessor and overwrites its own folder. Batches are taken in order
of arrival; an event older than its monitor's open window counts into that
window.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.operators.counters import MICROS
from reqsieve.operators.flush import flush_partials, merge_partials, present_windows
from reqsieve.schemas import COUNTERS
from reqsieve.sources.sinks import Sink, no_sink, stored_batch
from reqsieve.streaming import snapshots
from reqsieve.streaming.snapshots import COMPACT_EVERY

_STORED = (
    "monitor_id string, start_ms long, "
    + ", ".join(f"{c} long" for c in (*COUNTERS, MICROS))
    + ", last_ts timestamp, closed boolean"
)


def advance(scored: DataFrame, open_windows: DataFrame, period: str, **options) -> DataFrame:
    """Windows after one more batch: those left open before, continued, and new ones."""
    fresh = flush_partials(scored, period, starts=open_windows.select("monitor_id", "start_ms"), **options)
    return merge_partials(fresh.unionByName(open_windows))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def start_flush(
    scored: DataFrame,
    out: str,
    checkpoint: str,
    period: str = "PT30S",
    sink: Sink = no_sink,
    trigger: Mapping[str, object] | None = None,
    compact_every: int = COMPACT_EVERY,
    scored_out: str | None = None,
    **options,
) -> StreamingQuery:
    """Write the windows after each micro-batch, and hand those it closed to ``sink``; with ``scored_out``
    the scored requests go there first and the windows are made from what was written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if scored_out is not None:
            batch = stored_batch(batch, scored_out, batch_id)
        if batch_id == 0:
            before = spark.createDataFrame([], _STORED)
        else:
            before = _stored(spark, f"{out}/batch_id={batch_id - 1}").filter(~F.col("closed"))
        rows = batch.persist()
        try:
            path = f"{out}/batch_id={batch_id}"
            advance(rows, before, period, **options).write.mode("overwrite").partitionBy("closed").parquet(path)
        finally:
            rows.unpersist()
        if sink is not no_sink:
            sink(present_windows(_stored(spark, path)), batch_id)
        # the batch before this one is the state that a repetition reads
        if batch_id > 1 and batch_id % compact_every == 0:
            snapshots.compact(spark, out, batch_id - 2, lambda paths: merge_partials(_closed(spark, paths)))

    return (
        scored.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _closed(spark: SparkSession, paths: list[str]) -> DataFrame:
    merged, batches = [p for p in paths if "/upto=" in p], [p for p in paths if "/batch_id=" in p]
    # ``closed`` is a folder of a batch, and a column of what was merged
    read = [_stored(spark, p) for p in merged]
    if batches:
        base = batches[0].rpartition("/")[0]
        read.append(spark.read.schema(_STORED + ", batch_id long").option("basePath", base).parquet(*batches).drop("batch_id"))
    return reduce(DataFrame.unionByName, read).filter("closed")


def closed_windows(spark: SparkSession, out: str) -> DataFrame:
    """Every window closed so far; the events without a time of all batches are one window per monitor."""
    paths = snapshots.paths(out, *snapshots.parts(spark, out))
    return present_windows(merge_partials(_closed(spark, paths)))
