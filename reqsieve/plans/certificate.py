"""Is a fitted regression optimal? The gradient of its penalised loss, from one aggregate.

The loss is that of Spark ML's logistic regression: with ``s`` the deviation of a feature
over the rows learned from (one-hot slots included) and ``b = coefficient * s``,

    mean log loss + reg * (alpha * sum |b| + (1 - alpha) / 2 * sum b * b)

over all coefficients but the intercept. At the optimum, with ``g`` the gradient of the mean
log loss by ``b``: ``g + reg * (1 - alpha) * b + reg * alpha * sign(b)`` is 0 where ``b`` is not 0,
``|g|`` is at most ``reg * alpha`` where it is, and the gradient by the intercept is 0. How far a
coefficient is from that is its ``violation``; no fit has to be repeated to see it.

At coefficients of 0 the same sums tell the largest penalty that leaves any coefficient (``path.py``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.operators.score import OK, score
from reqsieve.plans.portable import CATEGORY, INTERCEPT, NUMERIC, PortableModel
from reqsieve.plans.training import ELASTIC_NET_PARAM, REG_PARAM, Encoding, complete
from reqsieve.schemas import LABEL
from reqsieve.session import cut_lineage
from reqsieve.sizing import join_side

_INTERCEPT = "(intercept)"


def _inputs(numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """What a row adds to each coefficient: ``(feature, kind, category, x)``."""

    def entry(feature: str, kind: str, category: Column, x: Column) -> Column:
        return F.struct(F.lit(feature).alias("feature"), F.lit(kind).alias("kind"), category.cast("string").alias("category"), x.cast("double").alias("x"))

    none, one = F.lit(None), F.lit(1.0)
    entries = [entry(_INTERCEPT, INTERCEPT, none, one)]
    entries += [entry(f, NUMERIC, none, F.col(f)) for f in numeric]
    return F.array(*entries, *[entry(f, CATEGORY, F.col(f), one) for f in categorical])


def _sums(rows: DataFrame, residual: Column, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per coefficient the rows ``n`` that have it, ``sum(residual * x)``, ``sum(x)`` and the variance over
    its own rows. Combined per task: a category with a third of all rows is one row per task."""
    flat = rows.select(residual.alias("residual"), F.inline(_inputs(numeric, categorical)))
    summed = flat.groupBy("feature", "kind", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("residual") * F.col("x")).alias("rx"), F.sum("x").alias("sx"), F.var_samp("x").alias("own_variance")
    )
    return cut_lineage(summed, "gradient")


def _standardised(sums: DataFrame) -> DataFrame:
    """``deviation`` and ``gradient`` of each coefficient, the intercept's by itself."""
    total = (sums.filter(F.col("kind") == INTERCEPT).first() or {"n": 0})["n"]  # one row
    share = F.col("sx") / total
    # a slot is 1 on its own rows and 0 on all others
    variance = F.when(F.col("kind") == CATEGORY, share * (1 - share) * total / max(total - 1, 1)).otherwise(F.col("own_variance"))
    deviation = F.when(F.col("kind") == INTERCEPT, 1.0).otherwise(F.sqrt(F.coalesce(variance, F.lit(0.0))))
    return sums.withColumn("deviation", deviation).withColumn("gradient", F.try_divide(F.col("rx") / total, F.col("deviation")))


def optimality(
    rows: DataFrame,
    table: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    reference: Mapping[str, str] | None = None,
    reg_param: float = REG_PARAM,
    elastic_net_param: float = ELASTIC_NET_PARAM,
    label: str = LABEL,
) -> DataFrame:
    """``(feature, kind, category, coefficient, deviation, gradient, violation)`` of a coefficient table on
    the rows it was fitted on.

    Rows that a fit leaves out (a null number or label, an unseen category) are left out. ``reference``
    names each feature's category without a coefficient of its own, whose violation is null.
    """
    scored = score(complete(rows, numeric, label), PortableModel.from_table(table)).filter(F.col("status") == OK)
    sums = _standardised(_sums(scored, F.col("probability_1") - F.col(label), numeric, categorical))
    sums = sums.select("feature", F.coalesce("category", F.lit("")).alias("named"), "deviation", "gradient")
    entries = table.select("feature", "kind", "category", F.coalesce("category", F.lit("")).alias("named"), "coefficient")
    joined = entries.join(join_side(sums), ["feature", "named"], "left")
    deviation, gradient = (F.coalesce(c, F.lit(0.0)) for c in ("deviation", "gradient"))
    scaled, lasso = F.col("coefficient") * F.col("deviation"), reg_param * elastic_net_param
    smooth = F.col("gradient") + reg_param * (1 - elastic_net_param) * scaled
    held = F.lit(False)
    for feature, category in (reference or {}).items():
        held = held | ((F.col("feature") == feature) & (F.col("category") == category))
    violation = (
        F.when(F.col("kind") == INTERCEPT, F.abs("gradient"))
        .when(held, F.lit(None))
        .when(F.col("deviation") == 0, F.abs("coefficient"))
        .when(scaled != 0, F.abs(smooth + lasso * F.signum(scaled)))
        .otherwise(F.greatest(F.abs("gradient") - lasso, F.lit(0.0)))
    )
    found = joined.withColumns({"deviation": deviation, "gradient": gradient})
    return found.withColumn("violation", violation).drop("named")


def reference_categories(encoding: Encoding) -> dict[str, str]:
    """The category of each feature that one-hot encoding leaves out: the last one."""
    last = {c: encoding.sizes[c][0] - 1 for c in encoding.categorical if encoding.sizes[c][0]}
    wanted = F.lit(False)
    for feature, idx in last.items():
        wanted = wanted | ((F.col("feature") == feature) & (F.col("idx") == idx))
    return {r.feature: r.category for r in encoding.known.filter(wanted).collect()}  # one per feature


def gradient_at_zero(rows: DataFrame, encoding: Encoding, label: str = LABEL) -> DataFrame:
    """``(feature, kind, category, deviation, gradient)`` at coefficients of 0 and the best intercept, from one scan.

    With the mean label as every row's probability, the residuals add up from sums of the label
    alone. Features without deviation and reference categories are left out.
    """
    numeric, categorical = encoding.numeric, encoding.categorical
    known = complete(rows, numeric, label)
    if categorical:
        known = encoding.index(known)
    sums = _sums(known, F.col(label), numeric, categorical)
    whole = sums.filter(F.col("kind") == INTERCEPT).first()  # one row
    mean = whole["rx"] / whole["n"] if whole else 0.0
    at_zero = _standardised(sums.withColumn("rx", mean * F.col("sx") - F.col("rx")))
    kept = (F.col("kind") != INTERCEPT) & (F.col("deviation") > 0)
    for feature, category in reference_categories(encoding).items():
        kept = kept & ~((F.col("feature") == feature) & F.col("category").eqNullSafe(category))
    return at_zero.filter(kept).select("feature", "kind", "category", "deviation", "gradient")
