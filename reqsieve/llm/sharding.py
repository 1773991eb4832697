"""Shards by jump consistent hashing, and gapless places within a shard.

The shard of a key follows from the key and the number of shards alone: no ring, no
table. Appending a shard moves rows only into it, about one in ``shards + 1``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows numbered by one task at most, about.
SLICE_ROWS = 200_000

# Fixed values of jump consistent hashing: the generator's factor and its scale.
_FACTOR, _SCALE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards - 1``, of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    ahead = np.zeros(len(keys), np.int64)
    while len(going):
        shard[going] = ahead
        state = state * _FACTOR + np.uint64(1)
        ahead = ((ahead + 1) * (_SCALE / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        left = ahead < shards
        going, state, ahead = going[left], state[left], ahead[left]
    return shard


def jump_shard(key: Column | str, shards: int) -> Column:
    """Shard of a whole-number key; a null key is taken as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(0)).cast("long"))


def assign_shards(rows: DataFrame, key: str, shards: int, order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``.

    ``slot`` counts from 0 without gaps in each shard, in the order of slices by a hash of
    the ``order`` columns and then of these columns; equal rows stand next to each other
    in no defined order. A null key goes where key 0 goes. An empty table stays empty.
    Columns of ``rows`` named like the results are replaced.

    A shard is numbered in slices of about ``slice_rows`` rows, each by one task, and the
    counts of the slices are added up: no task sees a whole shard. Pass narrow rows:
    they are shuffled once by shard and slice.
    """
    names = [c for c in rows.columns if c not in ("shard", "grown_shard", "slot")]
    # inner names, so that no column of the rows meets one made here
    kept = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key, order = f"c{names.index(key)}", [f"c{names.index(c)}" for c in order]
    slices = max(1, -(-rows.count() // (shards * slice_rows)))
    # the key takes part, so that many rows of one text or source spread over slices
    part = F.pmod(F.xxhash64(key, *order), F.lit(slices))
    placed = kept.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1), "_slice": part})
    counts = placed.groupBy("shard", "_slice").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy(*order))
    numbered = placed.withColumn("_within", within - 1).join(offsets, ["shard", "_slice"])
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "grown_shard", (F.col("_before") + F.col("_within")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, key: str, shards: int) -> None:
    """Write one folder per shard (``shard=0`` and so on), each by several tasks."""
    rows.drop("shard").withColumn("shard", jump_shard(key, shards)).write.partitionBy("shard").parquet(path)
