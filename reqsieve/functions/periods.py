"""ISO-8601 durations, read once on the driver."""

from __future__ import annotations

import re
from decimal import Decimal

_PERIOD = re.compile(
    r"P(?:(?P<years>\d+)Y)?(?:(?P<months>\d+)M)?(?:(?P<weeks>\d+)W)?(?:(?P<days>\d+)D)?"
    r"(?:T(?:(?P<hours>\d+)H)?(?:(?P<minutes>\d+)M)?(?:(?P<seconds>\d+(?:\.\d{1,3})?)S)?)?"
)
_MILLIS = {
    "weeks": 604_800_000,
    "days": 86_400_000,
    "hours": 3_600_000,
    "minutes": 60_000,
    "seconds": 1_000,
}


def period_millis(text: str) -> int:
    """``'PT30S'`` -> 30000. Years and months have no fixed length and are refused."""
    match = _PERIOD.fullmatch(text)
    parts = {k: v for k, v in match.groupdict().items() if v is not None} if match else {}
    if not parts or text.endswith("T"):
        raise ValueError(f"not an ISO-8601 period: {text!r}")
    if any(int(parts.get(unit, 0)) for unit in ("years", "months")):
        raise ValueError(f"period has no fixed length: {text!r}")
    millis = sum(Decimal(parts.get(unit, 0)) * scale for unit, scale in _MILLIS.items())
    if millis <= 0:
        raise ValueError(f"period must be positive: {text!r}")
    return int(millis)


def period_interval(text: str) -> str:
    """``'PT30S'`` -> ``'30000 milliseconds'``, the form ``F.window`` takes."""
    return f"{period_millis(text)} milliseconds"
