"""Request-filter scoring on Spark: normalize, train, score, monitor."""

from reqsieve.config import EngineConfig
from reqsieve.plans.batch import score_and_monitor, score_labelled
from reqsieve.plans.portable import PortableModel, coefficient_table

__all__ = [
    "EngineConfig",
    "PortableModel",
    "coefficient_table",
    "score_and_monitor",
    "score_labelled",
]
