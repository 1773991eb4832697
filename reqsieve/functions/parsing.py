"""Text to number under the JVM's own number grammar.

``try_cast`` alone is too generous (it trims integers and takes ``inf``), so the
text is matched first. Integers allow no blanks; doubles may be blank-padded
and carry a type suffix, as the public ``Double.valueOf`` grammar says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number texts.
INTEGER_TEXT = r"\A[+-]?[0-9]+\z"
DOUBLE_TEXT = (
    r"\A[\x00-\x20]*[+-]?(NaN|Infinity"
    r"|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?"
    r"|0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFdD]?"
    r")[\x00-\x20]*\z"
)


def parse_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def parse_int(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("int"))


def parse_double(text: Column) -> Column:
    return F.when(text.rlike(DOUBLE_TEXT), text.try_cast("double"))


def parse_flag(text: Column) -> Column:
    """``'0'`` is false; every other text, the empty one included, is true."""
    return text != F.lit("0")
