"""Request lines as comma-separated text, without quoting.

A row is kept only if all its numbers parse; everything else goes to a reject
table with the first reason, so kept + rejected = lines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.parsing import parse_double, parse_flag, parse_int, parse_long
from reqsieve.schemas import CSV_COLUMNS, CSV_LINE, LABEL, RAW_REQUEST

_PARSED = {
    "publisherId": parse_long,
    "age": parse_int,
    "height": parse_int,
    "width": parse_int,
    "rtbFloorSent": parse_double,
    LABEL: parse_double,
}
_FLAGS = ("withBundleId", "withGeoInfo")
_REJECT = "reject_reason"


# What a line of a file can be.
KEPT, REJECTED, HEADER, BLANK = "kept", "rejected", "header", "blank"
_KINDS = (KEPT, REJECTED, HEADER, BLANK)

# One header line per file. Quotes are plain characters, extra fields are ignored, and a
# short line has nulls at its end.
_OPTIONS = {"header": True, "quote": "", "mode": "PERMISSIVE"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The 13 text columns of every line of a file, folder or glob."""
    return spark.read.schema(CSV_LINE).options(**_OPTIONS).csv(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same for new files of a folder, as a stream; ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(CSV_LINE).options(**_OPTIONS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(path)


def _texts() -> dict[str, Column]:
    # The reader gives null for an empty field. Rows whose last field is null
    # are rejected, so for the rest null can only stand for the empty text.
    return {c: F.coalesce(F.col(c), F.lit("")) for c in CSV_COLUMNS}


def _reason(texts: dict[str, Column]) -> Column:
    reason = F.lit(None).cast("string")
    for name in reversed(_PARSED):
        reason = F.when(_PARSED[name](texts[name]).isNull(), name).otherwise(reason)
    return reason


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed requests with their label; malformed lines are left out."""
    texts = _texts()
    kept = lines.filter(_reason(texts).isNull())
    extra = [c for c in lines.columns if c not in CSV_COLUMNS]
    return kept.select(*extra, F.col("id"), *_values(texts))


def _values(texts: dict[str, Column]) -> list[Column]:
    columns = []
    for name in (*RAW_REQUEST.fieldNames(), LABEL):
        if name in _PARSED:
            value = _PARSED[name](texts[name])
        elif name in _FLAGS:
            value = parse_flag(texts[name])
        else:
            value = texts[name]
        columns.append(value.alias(name))
    return columns


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that did not parse, with the first field that failed."""
    reason = _reason(_texts())
    return lines.withColumn(_REJECT, reason).filter(F.col(_REJECT).isNotNull())


def account_lines(spark: SparkSession, path: str, out: str, header: str = ",".join(CSV_COLUMNS)) -> None:
    """Write every line of the files to one folder per kind, in one scan and one write.

    ``kind=kept`` holds the typed requests, ``kind=rejected`` the line and the first field that failed,
    and ``header`` and ``blank`` lines are only told apart; each row names its file. A header is a line equal to
    ``header`` in the first block of a file; any other first line is a rejected one.
    """
    read = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first_block")
    )
    fields = read.withColumn("fields", F.split("value", ",", -1))
    lines = fields.select("value", "file", "first_block", *[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(CSV_COLUMNS)])
    texts = _texts()
    reason = _reason(texts)
    kind = (
        F.when(F.trim("value") == "", BLANK)
        .when(F.col("first_block") & (F.col("value") == header), HEADER)
        .when(reason.isNull(), KEPT)
        .otherwise(REJECTED)
    )
    marked = lines.withColumn("kind", kind)
    is_kept, is_rejected = F.col("kind") == KEPT, F.col("kind") == REJECTED
    names = (*RAW_REQUEST.fieldNames(), LABEL)
    values = [F.when(is_kept, value).alias(name) for name, value in zip(names, _values(texts))]
    told = [F.when(is_rejected, F.col("value")).alias("line"), F.when(is_rejected, reason).alias(_REJECT)]
    marked.select("file", F.when(is_kept, F.col("id")).alias("id"), *values, *told, "kind").write.partitionBy("kind").parquet(out)


def accounted(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The rows of one kind; only their folder is read."""
    rows = spark.read.parquet(out).filter(F.col("kind") == kind).drop("kind")
    return rows.drop("line", _REJECT) if kind == KEPT else rows.select("file", "line", _REJECT)


def accounting(spark: SparkSession, out: str) -> DataFrame:
    """Lines of each file by kind: ``(file, n_lines, n_kept, n_rejected, n_header, n_blank)``."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in _KINDS]
    return spark.read.parquet(out).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), *counts)
