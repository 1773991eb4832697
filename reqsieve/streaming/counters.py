"""Counters of a stream per tumbling window.

The counters are additive, so nothing has to be kept open: every micro-batch
writes what its own events add to their windows, however late they are, and
the sum over all batches is the report. There is no state and no watermark,
and the sink of a batch gets each event exactly once.

    <out>/batch_id=<n>     what batch n adds
    <out>/upto=<n>         the sums of batches 0 to n, which replace their folders
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reqsieve.operators.counters import merge_counters, present, window_counters
from reqsieve.sources.sinks import Sink, no_sink, stored_batch
from reqsieve.streaming import snapshots
from reqsieve.streaming.snapshots import COMPACT_EVERY


def start_counters(
    scored: DataFrame,
    out: str,
    checkpoint: str,
    period: str = "PT30S",
    by: Sequence[str] = (),
    threshold: float | None = 0.7,
    ts: str = "ts",
    sink: Sink = no_sink,
    trigger: Mapping[str, object] | None = None,
    compact_every: int = COMPACT_EVERY,
    scored_out: str | None = None,
) -> StreamingQuery:
    """Write what each micro-batch adds to the windows, and hand it to ``sink``.

    A batch overwrites its own folder, so running it again after a failure
    leaves the same result; ``stream_report`` adds everything up. With ``scored_out`` the scored
    requests themselves go there first, and what was written is counted: one query
    scores once for both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch_id={batch_id}"
        if scored_out is not None:
            batch = stored_batch(batch, scored_out, batch_id)
        added = window_counters(batch, period, ts, by, threshold)
        added.write.mode("overwrite").parquet(path)
        if sink is not no_sink:
            sink(present(batch.sparkSession.read.schema(added.schema).parquet(path)), batch_id)
        if batch_id and batch_id % compact_every == 0:
            compact(batch.sparkSession, out, batch_id - 1, by, keep=True)  # all before this one are final

    return (
        scored.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact(spark: SparkSession, out: str, last: int, by: Sequence[str] = (), keep: bool = False) -> None:
    """Add up all batches up to ``last`` and drop their folders, with ``keep`` at the next compaction only."""
    keys = ["window_start", *by]
    snapshots.compact(spark, out, last, lambda paths: merge_counters(spark.read.parquet(*paths), keys), keep)


def stream_report(spark: SparkSession, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The counters per window, in additive form, from everything written so far.

    Can be read until two more compactions have run, by a stream that goes on.
    """
    paths = snapshots.paths(out, *snapshots.parts(spark, out))
    shape = spark.read.parquet(paths[0]).schema  # of one part, not of each
    return merge_counters(spark.read.schema(shape).parquet(*paths), ["window_start", *by])
