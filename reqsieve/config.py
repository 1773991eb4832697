"""Engine settings as one plain record."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from reqsieve.functions.periods import period_millis


@dataclass(frozen=True)
class EngineConfig:
    # The defaults every job starts from.
    threshold: float | None = 0.7
    log_update_period: str = "PT30S"
    metric_monitoring: bool = False
    send_metric_logging: bool = True
    model_location: str | None = None

    def __post_init__(self) -> None:
        period_millis(self.log_update_period)
        # -1 is the written form of "no confidence gate".
        if self.threshold is not None and float(self.threshold) == -1.0:
            object.__setattr__(self, "threshold", None)

    @classmethod
    def from_mapping(cls, values: Mapping[str, object]) -> EngineConfig:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)
