"""Tables that grow by one part per micro-batch, and can be read while older parts are merged.

    <out>/batch_id=<n>     the part of batch n, overwritten when the batch is repeated
    <out>/upto=<n>         batches 0 to n merged

A part counts once it is finished, and a merged one replaces what it was made from. What is replaced stays
for one more merge, so that a report opened before one can still be read after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from reqsieve.session import remove, written_folders

#: Every so many batches the older ones are merged into one table.
COMPACT_EVERY = 100


def _numbers(names: Sequence[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def parts(spark: SparkSession, out: str) -> tuple[int, list[int]]:
    """The last merged batch (-1: none) and the batches after it."""
    names = written_folders(spark, out)
    upto = max(_numbers(names, "upto="), default=-1)
    return upto, [b for b in _numbers(names, "batch_id=") if b > upto]


def paths(out: str, upto: int, batches: Sequence[int]) -> list[str]:
    """The folders that make up the table. Raises when there are none."""
    found = ([f"{out}/upto={upto}"] if upto >= 0 else []) + [f"{out}/batch_id={b}" for b in batches]
    if not found:
        raise LookupError(f"no batch has been counted under {out}")
    return found


def compact(spark: SparkSession, out: str, last: int, merge: Callable[[list[str]], DataFrame], keep: bool = True) -> None:
    """Merge all batches up to ``last``; with ``keep`` what this replaces goes with the next merge only."""
    names = written_folders(spark, out)
    upto, batches = parts(spark, out)
    old = [b for b in batches if b <= last]
    if not old:
        return
    merge(paths(out, upto, old)).write.mode("overwrite").parquet(f"{out}/upto={last}")
    # replaced by an earlier merge, or by this one
    bound = upto if keep else last
    gone = [f"batch_id={b}" for b in _numbers(names, "batch_id=") if b <= bound]
    gone += [f"upto={u}" for u in _numbers(names, "upto=") if u < bound or (not keep and u < last)]
    for name in gone:
        remove(spark, f"{out}/{name}")
