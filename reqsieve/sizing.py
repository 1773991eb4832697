"""Broadcast only what was counted to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.session import split_hot_keys

#: Bytes of values that are sent to every executor at most; in memory they take a few times that.
BROADCAST_BYTES = 16 << 20
_FIXED = 8


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: eight for a number or a null, more for texts and nested values."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        size = F.lit(0)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(df[field.name])
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(df[field.name])))
        total = total + F.coalesce(size, F.lit(0)) + F.lit(_FIXED)
    return total


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the values of ``df`` take at most ``max_bytes``; reads little further than that."""
    width = max(1, _FIXED * len(df.columns))
    sized = df.select(row_bytes(df).alias("bytes")).limit(max_bytes // width + 1)
    return (sized.agg(F.sum("bytes")).first()[0] or 0) <= max_bytes


def join_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES, known_bytes: int | None = None) -> DataFrame:
    """``df`` as the small side of a join.

    Counted small: broadcast, so the big side is not shuffled. Otherwise a
    sort-merge join, where AQE splits the partitions of hot keys; the hint keeps Spark from broadcasting
    it after all, since a table's files can be a small part of what its rows take on the driver. A
    caller that has counted already passes ``known_bytes``, and no job runs.
    """
    if known_bytes <= max_bytes if known_bytes is not None else fits(df, max_bytes):
        return F.broadcast(df)
    split_hot_keys(df.sparkSession)
    return df.hint("merge")
