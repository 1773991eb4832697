"""A stable id per raw request: equal rows get equal ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqsieve.schemas import RAW_REQUEST

_SEPARATOR = "\x1f"
# A null is told from any text by its mark.
_NULL, _VALUE = "n", "v"


def features_id(columns: Sequence[str] = tuple(RAW_REQUEST.fieldNames()), method: str = "md5") -> Column:
    """Hash of the raw fields as text.

    ``md5`` keeps ids distinct at hundreds of billions of rows; ``xxhash64`` is
    cheaper and enough where an id only spreads rows.
    """
    if method == "md5":
        texts = [F.coalesce(F.concat(F.lit(_VALUE), F.col(c).cast("string")), F.lit(_NULL)) for c in columns]
        return F.md5(F.concat_ws(_SEPARATOR, *texts))
    if method == "xxhash64":
        # xxhash64 skips nulls, so their positions are hashed as well.
        return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]).cast("string")
    raise ValueError(f"unknown id method: {method!r}")
