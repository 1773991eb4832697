"""Scoring a request stream: stateless, the same expressions as the batch job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reqsieve.plans.batch import score_labelled, score_unlabelled
from reqsieve.schemas import LABEL


def read_requests(spark, folder: str, schema, max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """A parquet folder as a stream; ``max_files`` per micro-batch sets the pace."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def score_stream(requests: DataFrame, model, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of a stream; the label is used where the stream carries one."""
    if LABEL in requests.columns:
        return score_labelled(requests, model, keep=keep)
    return score_unlabelled(requests, model, keep=keep)


def start_scoring(
    requests: DataFrame,
    model,
    out: str,
    checkpoint: str,
    keep: Sequence[str] = (),
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write scored requests as parquet; the file sink's log makes it exactly-once."""
    scored = score_stream(requests, model, keep)
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
