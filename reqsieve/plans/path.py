"""A path of falling penalties, from the largest useful one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.plans.certificate import gradient_at_zero
from reqsieve.plans.training import CATEGORICAL, NUMERIC, Encoding, Splits, Trial, tune
from reqsieve.schemas import LABEL
from reqsieve.session import cut_lineage

#: The looser tolerance of fits on a part of the training rows, which only rank.
RANKING_TOL = 1e-4


def largest_penalty(at_zero: DataFrame, elastic_net_param: float) -> float:
    """The least ``regParam`` from which on every coefficient is 0."""
    steepest = at_zero.agg(F.max(F.abs("gradient"))).first()[0] or 0.0
    if elastic_net_param <= 0:
        return float("inf") if steepest else 0.0
    return steepest / elastic_net_param


def falling_penalties(largest: float, points: int, least_share: float = 1e-3) -> list[float]:
    """``points`` penalties from the largest useful one down, at equal ratios."""
    if points < 2:
        return [largest][:points]
    return [largest * least_share ** (k / (points - 1)) for k in range(points)]


def tune_path(
    splits: Splits,
    source: DataFrame,
    elastic_net_param: float,
    points: int = 8,
    least_share: float = 1e-3,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    label: str = LABEL,
    params: Mapping[str, float] | None = None,
    rungs: Sequence[float] = (1.0,),
    seed: int = 17,
) -> list[Trial]:
    """Trials of penalties from the largest useful one down to its ``least_share``, the best first.

    Needs an ``elastic_net_param`` above 0: without it no penalty leaves out every coefficient.
    Each penalty is fitted on the whole training part. Only a caller that names shares of it as ``rungs`` gets a
    search on growing random parts: all penalties are fitted on the first, the better half goes on to the next, and so
    on; one that stops early ranks behind those that went on, and its trial has the ``share`` that it was fitted on.
    """
    if elastic_net_param <= 0:
        raise ValueError("a path needs an elastic_net_param above 0; name the penalties and use tune")
    encoding = Encoding.of(source, categorical, numeric)
    largest = largest_penalty(gradient_at_zero(splits.train, encoding, label), elastic_net_param)
    penalties, trials, train = falling_penalties(largest, points, least_share), [], splits.train
    if min(rungs) < 1:
        train = cut_lineage(train.withColumn("_draw", F.rand(seed)), "drawn")
    for k, share in enumerate(rungs):
        part = train.filter(F.col("_draw") < share).drop("_draw") if share < 1 else splits.train
        settings = {"tol": RANKING_TOL, **(params or {})} if share < 1 else params
        grid = {"regParam": penalties, "elasticNetParam": [elastic_net_param]}
        found = [replace(t, share=share) for t in tune(replace(splits, train=part), source, grid, categorical, numeric, label, settings, encoding)]
        on = len(found) if k == len(rungs) - 1 else max(1, -(-len(found) // 2))
        trials += found if k == len(rungs) - 1 else found[on:]
        penalties = [t.params["regParam"] for t in found[:on]]
    return sorted(trials, key=lambda t: (-t.share, -t.area_under_roc))
