"""Elastic-net logistic regression whose coefficients are a table, for any number of categories.

The loss is that of Spark ML's regression (``certificate.py`` states it), and so is the method: quasi-Newton
steps from the last gradients, kept to one orthant where absolute values are penalised (OWL-QN). Only where
the vectors are differs. The driver holds the numbers and the ``HEAD`` most frequent categories of
each feature; all other coefficients, with their gradients and last steps, are rows of a table.
A step needs the vectors' inner products alone, which are one aggregate. Fits of the same rows under several settings
go side by side, each by its own steps: the rows are read, joined and handed to Python once for a step of each. A category beyond the head has at most
a ``HEAD``-th of the rows, so rows can be dealt by it once, kept, and meet its coefficient without being
shuffled again; rows of the head are dealt at random.

A fit ends where the length of the gradient is at most ``LENGTH_PER_TOL`` times ``tol``, which bounds what any
coefficient is off by, as the certificate counts it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.session import Scratch, cut_lineage, remove

#: Categories of a feature, by falling frequency, whose coefficients the driver holds.
HEAD = 1024
#: Last steps that shape the next one, and how often a step is halved at most.
MEMORY, HALVINGS = 5, 25
LENGTH_PER_TOL = 30.0
#: Rows of a task, and the batches of them that are worked on at once.
TASK_ROWS, BATCHES = 200_000, 32
_FEATURE_BITS = 40


@dataclass(frozen=True)
class Fitted:
    """``weights``: ``(slot, weight)`` of the categories with a coefficient that is not 0."""

    intercept: float
    numbers: Sequence[float]
    weights: DataFrame
    iterations: int


def slot(feature: int, idx: Column) -> Column:
    """A category's number among those of all features."""
    return (F.lit(feature << _FEATURE_BITS) + idx).cast("long")


class _Layout:
    """Places on the driver: the numbers first, then each feature's head without the reference category."""

    def __init__(self, numbers: int, sizes: Sequence[int]):
        self.numbers, self.sizes = numbers, list(sizes)
        self.heads = [min(HEAD, max(n - 1, 0)) for n in sizes]
        self.offsets = [numbers + sum(self.heads[:k]) for k in range(len(sizes))]
        self.width = numbers + sum(self.heads)
        self.tails = sorted((k for k, n in enumerate(sizes) if n - 1 > HEAD), key=lambda k: -sizes[k])

    def slots(self) -> list[tuple[int, int]]:
        """``(place, slot)`` of each category on the driver."""
        return [(o + i, (k << _FEATURE_BITS) + i) for k, (o, h) in enumerate(zip(self.offsets, self.heads)) for i in range(h)]


def encode(rows: DataFrame, label: str, numeric: Sequence[str], indexes: Sequence[str], sizes: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Rows as the fit reads them: label, numbers, and of each feature the place of its head category (or -1)
    and the slot of a rarer one (or a negative number at random)."""
    at = _Layout(len(numeric), sizes)
    columns = [F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)]]
    for k, name in enumerate(indexes):
        idx = F.col(name).cast("long")
        columns.append(F.when(idx < at.heads[k], idx + at.offsets[k]).otherwise(-1).cast("int").alias(f"h{k}"))
        if k in at.tails:
            rare = (idx >= HEAD) & (idx < sizes[k] - 1)
            columns.append(F.when(rare, slot(k, idx)).otherwise(-1 - F.floor(F.rand(k) * (1 << 30))).cast("long").alias(f"t{k}"))
    return rows.select(*columns, *keep)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Numbers alone need no small batches."""
    while held := list(islice(batches, BATCHES)):
        yield pa.Table.from_batches(held)


def _sums(at: _Layout, fits: Sequence[int], weights: Sequence[np.ndarray], constants: Sequence[float]):
    """Sums over a task's rows, a column ``v`` for each fit: per slot the residuals; for place ``p`` of the driver under
    ``-1 - p``; the loss and all residuals under the two numbers after these."""
    inputs = at.numbers
    padded = [np.append(w, 0.0) for w in weights]
    names = ["slot", *[f"v{f}" for f in fits]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, losses, totals = np.zeros((len(fits), at.width + 1)), np.zeros(len(fits)), np.zeros(len(fits))
        for batch in _joined(batches):
            column = lambda name: batch.column(name).to_numpy()  # noqa: E731, B023
            y, xs = column("y"), [column(f"x{i}") for i in range(inputs)]
            places = [column(f"h{k}") for k in range(len(at.sizes))]
            counted = [np.where(place < 0, at.width, place) for place in places]
            residuals = []
            for j, f in enumerate(fits):
                margin = np.full(len(y), constants[j])
                for i, x in enumerate(xs):
                    margin += weights[j][i] * x
                for place in places:
                    margin += padded[j][place]
                for k in at.tails:
                    margin += np.nan_to_num(column(f"u{k}_{f}").astype(float))
                residual = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y
                losses[j] += float(np.sum(np.logaddexp(0.0, margin) - y * margin))
                totals[j] += float(residual.sum())
                for i, x in enumerate(xs):
                    head[j, i] += float(residual @ x)
                for place in counted:
                    head[j] += np.bincount(place, residual, at.width + 1)
                residuals.append(residual)
            for k in at.tails:
                slots, back = np.unique(column(f"t{k}"), return_inverse=True)
                found = [pa.array(np.bincount(back, residual, len(slots))[slots >= 0]) for residual in residuals]
                yield pa.RecordBatch.from_arrays([pa.array(slots[slots >= 0]), *found], names)
        values = [np.append(own[:-1], [loss, total]) for own, loss, total in zip(head, losses, totals)]
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(at.width + 2)), *map(pa.array, values)], names)

    return task


def _products(fits: Sequence[tuple[int, int, float, float]]):
    """Of each fit (number, steps, lasso, ridge): the inner products of a task's vectors, their penalty and promise, one after the other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2 * pairs + 1) ** 2 + 2) for _, pairs, _, _ in fits]
        for batch in _joined(batches):
            column = lambda name: batch.column(name).to_numpy()  # noqa: E731, B023
            for own, (f, pairs, lasso, ridge) in zip(sums, fits):
                b = column(f"b{f}")
                pg = _steepest(b, column(f"g{f}"), lasso, np.where)
                vectors = np.stack([*[column(f"{v}{f}_{i}") for v in "sy" for i in range(pairs)], pg])
                own[:-2] += (vectors @ vectors.T).ravel()
                own[-2] += ridge / 2 * float(b @ b) + lasso * float(np.abs(b).sum())
                own[-1] += float(column(f"p{f}").sum())
        values = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    return task


def _direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """The quasi-Newton direction as shares of the last steps, the last changes of the gradient, and the gradient,
    from their inner products alone."""
    share = np.zeros(2 * pairs + 1)
    share[-1] = -1.0
    alpha = np.zeros(pairs)
    for i in reversed(range(pairs)):
        alpha[i] = share @ gram[:, i] / gram[i, pairs + i]
        share[pairs + i] -= alpha[i]
    if pairs:
        share *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for i in range(pairs):
        share[i] += alpha[i] - share @ gram[:, pairs + i] / gram[i, pairs + i]
    return share


def _steepest(b, g, lasso, when):
    """The gradient with absolute values: at 0 what is left of it beyond the penalty."""
    at_zero = when(g + lasso < 0, g + lasso, when(g - lasso > 0, g - lasso, 0 * g))
    return when(b > 0, g + lasso, when(b < 0, g - lasso, at_zero))


def _stepped(b, pg, d, t, lasso, when):
    """A step of length ``t`` that leaves no orthant: what would change its sign stays at 0."""
    if lasso == 0:
        return b + t * d
    d = when(d * pg >= 0, 0 * d, d)
    to = b + t * d
    side = when(b > 0, 1 + 0 * b, when(b < 0, -1 + 0 * b, -pg))
    return when(to * side < 0, 0 * to, to)


def _when(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def fit(encoded: DataFrame, numbers: int, sizes: Sequence[int], settings: Mapping[str, float]) -> Fitted:
    """Fit on the rows of ``encode``; ``settings`` are those of Spark ML's regression."""
    return fit_each(encoded, numbers, sizes, [settings])[0]


def fit_each(encoded: DataFrame, numbers: int, sizes: Sequence[int], settings: Sequence[Mapping[str, float]]) -> list[Fitted]:
    """A fit of all rows for each of the settings, side by side: one pass over the rows is a step of each."""
    at, spark = _Layout(numbers, sizes), encoded.sparkSession
    first = encoded.agg(
        F.count(F.lit(1)), F.avg("y"), F.count_if(~F.col("y").isin(0.0, 1.0)),
        *[F.avg(f"x{i}") for i in range(numbers)], *[F.stddev_samp(f"x{i}") for i in range(numbers)],
    ).first()
    n, mean, strange = first[:3]
    if not n or strange:
        raise ValueError("a fit needs rows" if not n else f"{strange} labels are neither 0 nor 1")
    with Scratch(spark, "fit") as scratch:
        dealt = encoded
        if at.tails:
            key = f"t{at.tails[0]}"
            dealt = encoded.repartition(max(spark.sparkContext.defaultParallelism, n // TASK_ROWS + 1), key).sortWithinPartitions(key)
        dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _Search(dealt, at, first, settings, scratch).run()
        finally:
            dealt.unpersist()


class _Fit:
    """The search of one setting: its vectors' parts on the driver (the intercept first), and the inner products of the
    parts in the table, whose columns are ``b`` and ``g`` with the fit's number, ``s`` and ``y`` with those of the fit and the step."""

    def __init__(self, number: int, settings: Mapping[str, float], head: np.ndarray):
        reg, mix = settings["regParam"], settings["elasticNetParam"]
        self.number, self.lasso, self.ridge = number, reg * mix, reg * (1 - mix)
        self.end, self.most = LENGTH_PER_TOL * settings.get("tol", 1e-6), int(settings["maxIter"])
        self.head = self.to = head
        self.steps: list[np.ndarray] = []
        self.changes: list[np.ndarray] = []
        self.iterations, self.tries = 0, 0

    def name(self, vector: str, step: int | None = None) -> str:
        return f"{vector}{self.number}" if step is None else f"{vector}{self.number}_{step}"

    def columns(self) -> list[str]:
        return [self.name("b"), self.name("g"), *[self.name(v, i) for v in "sy" for i in range(len(self.steps))]]

    def penalty(self) -> float:
        b = self.to[1:]
        return self.ridge / 2 * float(b @ b) + self.lasso * float(np.abs(b).sum())

    def begin(self, loss: float, gradient: np.ndarray, gram: np.ndarray, rare: float) -> None:
        self.value, self.gradient, self.gram = loss + self.penalty() + rare, gradient, gram

    def aim(self) -> bool:
        """The next place to try; false at the end of the search."""
        if self.tries == 0:
            if self.iterations >= self.most:
                return False
            # the intercept has no penalty
            self.pg = np.append(self.gradient[0], _steepest(self.head[1:], self.gradient[1:], self.lasso, np.where))
            vectors, m = [*self.steps, *self.changes, self.pg], len(self.steps)
            whole = self.gram + np.array([[float(a @ b) for b in vectors] for a in vectors])
            length = whole[-1, -1] ** 0.5
            if length <= self.end:
                return False
            self.share, self.t = _direction(whole, m), 1.0 if m else min(1.0, 1 / length)
            self.d = sum(s * v for s, v in zip(self.share, vectors))
        elif self.tries == HALVINGS:
            return False  # no step makes the loss any smaller: as far as doubles go
        else:
            self.t /= 2
        self.to = np.append(self.head[0] + self.t * self.d[0], _stepped(self.head[1:], self.pg[1:], self.d[1:], self.t, self.lasso, np.where))
        return True

    def direction(self) -> Column:
        m = len(self.steps)
        columns = [*[F.col(self.name(v, i)) for v in "sy" for i in range(m)], F.col(self.name("pg"))]
        return sum((F.lit(float(s)) * c for s, c in zip(self.share, columns)), F.lit(0.0))

    def moved(self) -> list[Column]:
        """The columns after a step to ``c``, where the gradient is ``h``."""
        m, at = len(self.steps), lambda v: F.col(self.name(v))
        first = 1 if m == MEMORY else 0
        shifted = [F.col(self.name(v, i)).alias(self.name(v, i - first)) for v in "sy" for i in range(first, m)]
        step, change = (at("c") - at("b")).alias(self.name("s", m - first)), (at("h") - at("g")).alias(self.name("y", m - first))
        return [at("c").alias(self.name("b")), at("h").alias(self.name("g")), *shifted, step, change]

    def accept(self, loss: float, gradient: np.ndarray, gram: np.ndarray, rare: float, promise: float) -> list[str | Column]:
        """Goes on from the place that was tried, if the loss fell there; the columns of the next state."""
        value, promise = loss + self.penalty() + rare, promise + float(self.pg @ (self.to - self.head))
        if not value <= self.value + 1e-4 * promise:
            self.tries += 1
            return self.columns()
        columns: list[str | Column] = [*self.moved()]
        first = 1 if len(self.steps) == MEMORY else 0
        self.steps, self.changes = [*self.steps[first:], self.to - self.head], [*self.changes[first:], gradient - self.gradient]
        self.head, self.gradient, self.gram, self.value = self.to, gradient, gram, value
        self.iterations, self.tries = self.iterations + 1, 0
        step = len(self.steps) - 1
        if gram[step, 2 * step + 1] + float(self.steps[-1] @ self.changes[-1]) <= 0:  # a flat step says nothing about the next one
            self.steps, self.changes, self.gram = [], [], gram[-1:, -1:]
            return columns[:2]
        return columns


class _Search:
    """The state of fits of the same rows: arrays on the driver, and columns of one table with a row per rare category."""

    def __init__(self, rows: DataFrame, at: _Layout, first: Sequence[float], settings: Sequence[Mapping[str, float]], scratch: Scratch):
        self.rows, self.at, self.scratch, self.spark = rows, at, scratch, rows.sparkSession
        self.n, self.mean = first[0], first[1]
        odds = np.log(self.mean / (1 - self.mean)) if 0 < self.mean < 1 else np.inf if self.mean else -np.inf
        self.fits = [_Fit(f, s, np.append(odds, np.zeros(at.width))) for f, s in enumerate(settings)]
        keys = [F.col(f"h{k}").cast("long") for k in range(len(at.sizes))]
        keys = [F.when(h >= 0, -1 - h).when(F.col(f"t{k}") >= 0, F.col(f"t{k}")) if k in at.tails else F.when(h >= 0, -1 - h) for k, h in enumerate(keys)]
        used = rows.select(F.explode(F.array(*keys)).alias("slot")) if keys else self.spark.range(0).select(F.col("id").alias("slot"))
        counted = scratch.table(used.filter("slot IS NOT NULL").groupBy("slot").agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")
        self.means, deviations = np.zeros(at.width), np.zeros(at.width)
        self.means[: at.numbers] = first[3 : 3 + at.numbers]
        deviations[: at.numbers] = [d or 0.0 for d in first[3 + at.numbers :]]  # null for a single row
        for row in counted.filter("slot < 0").collect():  # HEAD rows a feature
            share = row.n / self.n
            self.means[-1 - row.slot] = share
            deviations[-1 - row.slot] = (share * (1 - share) * self.n / max(self.n - 1, 1)) ** 0.5
        # without deviation there is no coefficient
        self.scale = np.divide(1.0, deviations, out=np.zeros(at.width), where=deviations > 0)
        share = F.col("n") / self.n
        scale = 1.0 / F.sqrt(share * (1 - share) * self.n / max(self.n - 1, 1))
        rare = counted.filter((F.col("slot") >= 0) & (F.col("n") < self.n))
        zeros = [F.lit(0.0).alias(fit.name(v)) for fit in self.fits for v in "bgc"]
        self.start = rare.select("slot", scale.alias("scale"), *zeros)

    def _table(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        return self.scratch.table(df, name), f"{self.scratch.folder}/{self.scratch.count}-{name}"

    def _evaluate(self, trial: DataFrame, fits: Sequence[_Fit]) -> tuple[DataFrame, str, list[float], list[np.ndarray]]:
        """One pass over the rows: ``trial`` with each fit's gradient ``h`` at ``c``, the mean log losses, and the heads' gradients."""
        weights, numbers = [fit.to[1:] * self.scale for fit in fits], [fit.number for fit in fits]
        joined = self.rows
        for k in self.at.tails:
            own = trial.filter(F.col("slot").between(k << _FEATURE_BITS, ((k + 1) << _FEATURE_BITS) - 1))
            side = own.select(F.col("slot").alias(f"t{k}"), *[(F.col(f"c{f}") * F.col("scale")).alias(f"u{k}_{f}") for f in numbers]).hint("merge")
            joined = joined.join(side, f"t{k}", "left")
        constants = [float(fit.to[0] - self.means @ w) for fit, w in zip(fits, weights)]
        shape = ", ".join(["slot long", *[f"v{f} double" for f in numbers]])
        found = joined.mapInArrow(_sums(self.at, numbers, weights, constants), shape)
        sums, path = self._table(found.groupBy("slot").agg(*[F.sum(f"v{f}").alias(f"v{f}") for f in numbers]), "sums")
        values = np.zeros((len(fits), self.at.width + 2))
        for row in sums.filter("slot < 0").collect():  # HEAD rows a feature
            values[:, -1 - row.slot] = [row[f"v{f}"] for f in numbers]
        losses, gradients = [float(own[-2] / self.n) for own in values], []
        smooth = {}
        for fit, own in zip(fits, values):
            total = own[-1] / self.n
            gradient = (own[:-2] / self.n - self.means * total) * self.scale + fit.ridge * fit.to[1:]
            gradients.append(np.append(total, gradient))
            smooth[fit.name("h")] = F.coalesce(fit.name("v"), F.lit(0.0)) * F.col("scale") / self.n + fit.ridge * F.col(fit.name("c"))
        with_gradient = trial.join(sums.filter("slot >= 0").hint("merge"), "slot", "left").withColumns(smooth)
        return with_gradient, path, losses, gradients

    def _measure(self, tail: DataFrame, fits: Sequence[_Fit], pairs: Sequence[int]) -> list[tuple[np.ndarray, float, float]]:
        """Inner products of the tail's vectors, its penalty, and what the gradient promised for the last step, of each fit."""
        known = [(fit.number, m, fit.lasso, fit.ridge) for fit, m in zip(fits, pairs)]
        sides = [2 * m + 1 for m in pairs]
        values = np.zeros(sum(side**2 + 2 for side in sides))
        for row in tail.mapInArrow(_products(known), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # some hundred rows
            values[row.k] = row.v
        found, at = [], 0
        for side in sides:
            own, at = values[at : at + side**2 + 2], at + side**2 + 2
            found.append((own[:-2].reshape(side, side), float(own[-2]), float(own[-1])))
        return found

    def run(self) -> list[Fitted]:
        results: dict[int, Fitted] = {}
        if self.mean in (0.0, 1.0):  # one class only: Spark ML's answer
            return [self._result(fit, self.start) for fit in self.fits]
        found, sums_path, losses, gradients = self._evaluate(self.start, self.fits)
        kept = [c for fit in self.fits for c in (F.col(fit.name("c")).alias(fit.name("b")), F.col(fit.name("h")).alias(fit.name("g")), F.lit(0.0).alias(fit.name("p")))]
        tail, path = self._table(found.select("slot", "scale", *kept), "state")
        remove(self.spark, sums_path)
        for fit, loss, gradient, (gram, rare, _) in zip(self.fits, losses, gradients, self._measure(tail, self.fits, [0] * len(self.fits))):
            fit.begin(loss, gradient, gram, rare)
        going = self.fits
        while going:
            ended, going = going, [fit for fit in going if fit.aim()]
            results |= {fit.number: self._result(fit, tail) for fit in ended if fit not in going}
            if not going:
                break
            own = {fit.name("pg"): _steepest(F.col(fit.name("b")), F.col(fit.name("g")), fit.lasso, _when) for fit in going}
            drawn = tail.select("slot", "scale", *[c for fit in going for c in fit.columns()]).withColumns(own)
            drawn = drawn.withColumns({fit.name("d"): fit.direction() for fit in going})
            to = {fit.name("c"): _stepped(*[F.col(fit.name(v)) for v in ("b", "pg", "d")], fit.t, fit.lasso, _when) for fit in going}
            found, sums_path, losses, gradients = self._evaluate(drawn.withColumns(to), going)
            kept = [(F.col(fit.name("pg")) * (F.col(fit.name("c")) - F.col(fit.name("b")))).alias(fit.name("p")) for fit in going]
            kept += [c for fit in going for c in (*fit.columns(), fit.name("c"), fit.name("h"))]
            tried, next_path = self._table(found.select("slot", "scale", *kept), "state")
            remove(self.spark, sums_path)
            moved = tried.select(*[c for fit in going for c in (fit.name("p"), *fit.moved())])
            measured = self._measure(moved, going, [min(len(fit.steps) + 1, MEMORY) for fit in going])
            columns = [c for fit, loss, gradient, own in zip(going, losses, gradients, measured) for c in fit.accept(loss, gradient, *own)]
            tail = tried.select("slot", "scale", *columns)
            remove(self.spark, path)
            path = next_path
        return [results[fit.number] for fit in self.fits]

    def _result(self, fit: _Fit, tail: DataFrame) -> Fitted:
        head, weights = fit.head, fit.head[1:] * self.scale
        own = [(s, float(weights[p])) for p, s in self.at.slots()]
        rare = tail.select("slot", (F.col(fit.name("b")) * F.col("scale")).alias("weight"))
        found = self.spark.createDataFrame(own, "slot long, weight double").unionByName(rare).filter("weight <> 0")
        return Fitted(float(head[0] - self.means @ weights), [float(w) for w in weights[: self.at.numbers]], cut_lineage(found, "weights"), fit.iterations)
