"""A quality classifier learned from trusted positives and unlabelled text.

Only texts known to be good and text of unknown quality are used. A linear model over stepped
features minimises the non-negative unbiased risk

    prior * loss(positives, 1) + max(0, loss(unlabelled, 0) - prior * loss(positives, 0))

with a bounded loss (sigmoid), whose sampling noise does not drown the few bad texts. Where the second
part falls below 0 the fit takes a damped step back on it.

The share of good texts among the unlabelled (the class prior) is estimated first: plain classifiers tell
positives from unlabelled, each on all folds but one, and score the fold left out, so that no
text is scored by a model that has seen it. The prior is the least ratio of the unlabelled to the positive
mass above any threshold, as a stretch of scores that no bad text reaches has exactly that
ratio. The final weights are the mean of the folds' models. The scores of the texts
left out also set where a text is rejected: where the risk, counted in whole texts, is least, and
in any case below all but one in two hundred of the trusted positives.

A text's features are shares of its characters, words and lines, cut into quantile steps;
nothing else about the row is looked at. Steps and prior come from histograms over all rows, summed by task;
the gradient's fit uses a bounded sample (``POSITIVES`` labelled and ``UNLABELLED`` other rows,
picked by a threshold on the hash of their id); every text is scored, in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.llm import textbytes
from reqsieve.llm.worker import lean
from reqsieve.session import Scratch

#: Bounds of the sample that the classifier is fitted on.
POSITIVES, UNLABELLED = 10_000, 20_000
THRESHOLD = 0.3
#: Parts of the sample, each left out by one of the models.
FOLDS = 3
#: Share of the trusted positives that may be scored below the threshold.
LOST_POSITIVES = 0.005
_STEPS = 16
#: Cells of a feature's histogram: equal steps of its logarithm, from 2 ** -18 up.
_FEATURE_CELLS, _FINEST, _PER_DOUBLING = 2048, 18, 64
#: Bytes of text whose features are found at once; a task takes some 50 times as much for it.
_CHUNK = 1 << 18

# Character classes.
_UPPER, _LOWER, _DIGIT, _BEYOND, _STOP, _SHOUT, _QUOTE, _BRACKET, _PIPE, _MARK, _SPACE, _LINE, _OTHER = range(13)


def _character_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[0x41:0x5B], table[0x61:0x7B], table[0x30:0x3A], table[0x80:] = _UPPER, _LOWER, _DIGIT, _BEYOND
    for members, number in ((".,;:", _STOP), ("!?", _SHOUT), ("\"'-", _QUOTE), ("()[]{}<>/\\", _BRACKET), ("|", _PIPE), ("#$%&*+=@^_~`", _MARK)):
        table[list(members.encode())] = number
    table[[0x20, 0x09, 0x0D]], table[0x0A] = _SPACE, _LINE
    return table


_CLASS = _character_classes()
_SENTENCE_END = textbytes.byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    key = np.unique((row.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x features; all 0 for an empty text."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    place = np.repeat(np.arange(rows) * 16, size) + _CLASS[data]
    kinds = np.bincount(place, minlength=rows * 16).reshape(rows, 16).astype(float)
    word = textbytes.words(data, offsets)
    token = textbytes.words(data, offsets, textbytes.VISIBLE)
    line = textbytes.words(data, offsets, textbytes.LINE)
    word_row, token_row, line_row = word.row, token.row, line.row
    n_words, n_tokens, n_lines = (np.maximum(np.diff(x.bounds), 1) for x in (word, token, line))
    word_hash = textbytes.hashes(data, word)
    length = word.end - word.start
    shingle, shingle_row = textbytes.shingles(word_hash, word.bounds, 3)
    upper = np.bincount(word_row, (_CLASS[data[word.start]] == _UPPER) & (_CLASS[data[word.end - 1]] == _UPPER) & (length > 1), rows)
    again = np.zeros(len(word_hash), bool)
    again[1:] = (word_hash[1:] == word_hash[:-1]) & (word_row[1:] == word_row[:-1])
    last, first = _CLASS[data[token.end - 1]], _CLASS[data[token.start]]
    letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER], 1)
    total = np.maximum(size, 1)
    shares = [kinds[:, k] / total for k in (_DIGIT, _BEYOND, _STOP, _SHOUT, _QUOTE, _BRACKET, _PIPE, _MARK, _SPACE, _LINE, _OTHER)]
    columns = [
        *shares,
        kinds[:, _UPPER] / letters,
        upper / n_words,
        np.bincount(word_row, length, rows) / n_words,
        np.bincount(word_row, length > 12, rows) / n_words,
        _distinct(word_row, word_hash, rows) / n_words,
        _distinct(shingle_row, shingle, rows) / np.maximum(np.bincount(shingle_row, minlength=rows), 1),
        _distinct(line_row, textbytes.hashes(data, line), rows) / n_lines,
        np.bincount(line_row, _SENTENCE_END[data[line.end - 1]], rows) / n_lines,
        np.bincount(token_row, (last == _MARK) | (last == _SHOUT), rows) / n_tokens,
        np.bincount(token_row, (first == _MARK) | (first == _PIPE), rows) / n_tokens,
        np.bincount(word_row, again, rows) / n_words,
        np.log1p(np.diff(word.bounds)),
        np.log1p(n_words / n_lines),
        (np.diff(word.bounds) > 0).astype(float),
    ]
    return np.stack(columns, axis=1) * (size > 0)[:, None]


class Model(NamedTuple):
    steps: list[np.ndarray]  # per feature: where the next weight begins
    weights: np.ndarray
    prior: float


def _cells(model_steps: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which weight each feature of each row uses."""
    first = np.concatenate([[1], 1 + np.cumsum([len(s) + 1 for s in model_steps])[:-1]]) if model_steps else np.zeros(0, int)
    return np.stack([f + np.searchsorted(s, values[:, k], side="right") for k, (f, s) in enumerate(zip(first, model_steps))], axis=1)


def logits(model: Model, values: np.ndarray) -> np.ndarray:
    return model.weights[0] + model.weights[_cells(model.steps, values)].sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _totals(weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return weights[0] + weights[cells].sum(axis=1)


def _spread(cells: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    gradient = np.bincount(cells.ravel(), np.repeat(slope, cells.shape[1]), size)
    gradient[0] = slope.sum()
    return gradient / len(cells)


def risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased risk, unclipped, and the gradient of each."""
    p, u = _sigmoid(_totals(weights, positive)), _sigmoid(_totals(weights, unlabelled))
    up = prior * _spread(positive, p * (p - 1), len(weights))  # loss(positives, 1) is 1 - p
    down = _spread(unlabelled, u * (1 - u), len(weights)) - prior * _spread(positive, p * (1 - p), len(weights))
    return prior * float((1 - p).mean()), float(u.mean() - prior * p.mean()), up, down


def _apart(positive: np.ndarray, unlabelled: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of the plain logistic loss of positives against unlabelled."""

    def gradient(weights: np.ndarray) -> np.ndarray:
        up = _spread(positive, -_sigmoid(-_totals(weights, positive)), len(weights))
        return up + _spread(unlabelled, _sigmoid(_totals(weights, unlabelled)), len(weights))

    return gradient


def _non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Callable[[np.ndarray], np.ndarray]:
    def gradient(weights: np.ndarray) -> np.ndarray:
        _, negative, up, down = risk(weights, positive, unlabelled, prior)
        # below 0 the negative part is fitted too closely: step back on it
        return up + down if negative >= 0 else -0.1 * down

    return gradient


def _minimise(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int, decay: float) -> np.ndarray:
    weights, mean, square = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, rounds + 1):
        slope = gradient(weights) + decay * np.concatenate([[0], weights[1:]])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def _above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return 1 - np.searchsorted(np.sort(scores), cuts) / max(len(scores), 1)


def prior_from_shares(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int) -> float:
    """The prior from the shares of positives and unlabelled above rising thresholds."""
    use = above_p >= 0.05
    above_p, above_u = above_p[use], above_u[use]
    error = np.sqrt(above_u * (1 - above_u) / max(n_u, 1)) + np.sqrt(above_p * (1 - above_p) / max(n_p, 1))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of rows that were not learned from."""
    cuts = np.concatenate([[-np.inf], np.unique(np.quantile(positive, np.linspace(0, 0.95, 192)))])
    return prior_from_shares(_above(positive, cuts), _above(unlabelled, cuts), len(positive), len(unlabelled))


def _reject_below(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The threshold on scores of rows left out: least risk in whole texts, or what nearly all positives reach."""
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 400)))
    lost, kept = 1 - _above(positive, cuts), _above(unlabelled, cuts)
    whole = prior * lost + np.maximum(0, kept - prior * (1 - lost))
    return max(float(cuts[np.argmin(whole)]), float(np.quantile(positive, LOST_POSITIVES)))


class Plain(NamedTuple):
    """Models of positives against unlabelled, each for the fold that it has not seen."""

    steps: list[np.ndarray]
    weights: np.ndarray  # folds x weights


def feature_steps(values: np.ndarray) -> list[np.ndarray]:
    """Where steps begin: quantiles, and some of the tails, where few rows differ from many."""
    return [np.unique(np.quantile(values[:, k], _LEVELS)) for k in range(values.shape[1])]


_LEVELS = np.concatenate([np.linspace(0, 1, _STEPS + 1)[1:-1], [0.005, 0.02, 0.98, 0.995]])


def fit_plain(positive: np.ndarray, unlabelled: np.ndarray, folds: tuple[np.ndarray, np.ndarray], steps: list[np.ndarray]) -> Plain:
    size = 1 + sum(len(s) + 1 for s in steps)
    p, u = _cells(steps, positive), _cells(steps, unlabelled)
    models = [_minimise(_apart(p[folds[0] != k], u[folds[1] != k]), np.zeros(size), 150, 1e-3) for k in range(FOLDS)]
    return Plain(steps, np.stack(models))


def left_out_scores(plain: Plain, values: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's score by the model that has not seen its fold."""
    cells = _cells(plain.steps, values)
    return (plain.weights[:, 0][fold]) + np.take_along_axis(plain.weights[fold], cells, axis=1).sum(axis=1)


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    folds: tuple[np.ndarray, np.ndarray] | None = None,
    steps: list[np.ndarray] | None = None,
    plain: Plain | None = None,
    prior: float | None = None,
) -> Model:
    """The model of two samples of feature rows; without enough of either every score is the middle one.

    ``folds`` numbers the fold of each row of both samples, such that a text is in one
    fold only; ``steps``, ``plain`` and ``prior`` are made from the samples if they are not given.
    """
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return Model([], np.zeros(1), 0.5)
    if folds is None:
        folds = np.arange(len(positive)) % FOLDS, np.arange(len(unlabelled)) % FOLDS
    if min(np.bincount(f, minlength=FOLDS).min() for f in folds) == 0:
        return Model([], np.zeros(1), 0.5)
    steps = steps or feature_steps(np.concatenate([positive, unlabelled]))
    plain = plain or fit_plain(positive, unlabelled, folds, steps)
    if prior is None:
        prior = estimate_prior(left_out_scores(plain, positive, folds[0]), left_out_scores(plain, unlabelled, folds[1]))
    p, u = _cells(steps, positive), _cells(steps, unlabelled)
    models = [_minimise(_non_negative(p[folds[0] != k], u[folds[1] != k], prior), plain.weights[k], 200, 1e-4) for k in range(FOLDS)]
    own = Plain(steps, np.stack(models))
    limit = _reject_below(left_out_scores(own, positive, folds[0]), left_out_scores(own, unlabelled, folds[1]), prior)
    weights = np.mean(models, axis=0)
    weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - limit
    return Model(steps, weights, prior)


def score(model: Model, values: np.ndarray) -> np.ndarray:
    """0 to 1: how likely each row is good."""
    if not model.steps:
        return np.full(len(values), 0.5)
    return _sigmoid(logits(model, values))


def _text_features(column: pa.Array) -> np.ndarray:
    parts = [features(data, offsets) for _, _, data, offsets in textbytes.text_chunks(column, _CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, 1))


def _histogram_cell(values: np.ndarray) -> np.ndarray:
    """The cell of a feature's value, which is never negative; 0 for 0."""
    logs = np.log2(np.maximum(values, 2.0**-_FINEST)) + _FINEST
    return np.where(values > 0, np.clip(1 + logs * _PER_DOUBLING, 1, _FEATURE_CELLS - 1), 0).astype(np.int64)


def _cell_start(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** ((cell - 1) / _PER_DOUBLING - _FINEST), 0.0)


def _steps_of(counts: np.ndarray) -> list[np.ndarray]:
    """Steps from histograms, features x cells."""
    found = []
    for row in counts:
        total = np.cumsum(row)
        found.append(np.unique(_cell_start(np.searchsorted(total, _LEVELS * total[-1], side="left").clip(0, _FEATURE_CELLS - 1))))
    return found


def _fold(id: str) -> Column:
    return F.pmod(F.xxhash64(id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _picked(id: str, most: int, rows: int) -> Column:
    """True for somewhat more than ``most`` of ``rows`` rows, by the hash of their id alone."""
    span, ample = 1 << 40, most + most // 4 + 50
    return F.pmod(F.xxhash64(id, F.lit("quality")), F.lit(span)) < span * ample // max(rows, ample)


def train(docs: DataFrame, positives: DataFrame, text: str = "text", id: str = "doc_id", most_positive: int = POSITIVES, most_unlabelled: int = UNLABELLED) -> Model:
    """Fit on the texts of the ids in ``positives`` and on unlabelled texts of ``docs``: about ``most_positive``
    and ``most_unlabelled`` rows, by the hash of their id. Ids that are null or not in ``docs`` play no part
    in the sample; all rows count for steps and prior."""
    known = positives.select(F.col(id).alias("_known")).filter("_known IS NOT NULL").distinct()
    known = known.filter(_picked("_known", most_positive, known.count())).withColumn("_good", F.lit(True))  # a bounded list
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text"))
    total = rows.count()
    web = F.coalesce(F.col("_id").isNotNull() & _picked("_id", most_unlabelled, total), F.lit(False))
    marked = rows.join(F.broadcast(known), F.col("_id") == F.col("_known"), "left")
    marked = marked.select("text", _fold("_id").alias("_fold"), F.coalesce("_good", F.lit(False)).alias("_good"), web.alias("_web"))
    with Scratch(docs.sparkSession, "quality") as scratch:
        gathered = scratch.table(_gather(marked), "gathered")
        sample = _sample(gathered, most_positive, most_unlabelled)
        width = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
        counts = np.zeros((width, _FEATURE_CELLS), np.int64)
        for r in gathered.filter("feature >= 0").groupBy("feature", "cell").agg(F.sum("n").alias("n")).collect():  # features x cells
            counts[r.feature, r.cell] = r.n
        positive, unlabelled, folds = sample
        if min(len(positive), len(unlabelled)) < 2 * FOLDS or min(np.bincount(f, minlength=FOLDS).min() for f in folds) == 0:
            return fit(positive[:0], unlabelled[:0])
        plain = fit_plain(positive, unlabelled, folds, _steps_of(counts))
        prior = _prior_of_all(marked, plain, left_out_scores(plain, positive, folds[0]))
        return fit(positive, unlabelled, folds, plain.steps, plain, prior)


_GATHERED = "feature int, cell int, n long, fold int, good boolean, web boolean, values array<double>"


def _gather(marked: DataFrame) -> DataFrame:
    """Each task's histograms of all features of its rows, and the features of the rows picked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            if not len(batch):
                continue
            values = _text_features(batch.column("text"))
            counts = np.zeros((values.shape[1], _FEATURE_CELLS), np.int64) if counts is None else counts
            for k in range(values.shape[1]):
                counts[k] += np.bincount(_histogram_cell(values[:, k]), minlength=_FEATURE_CELLS)
            good, web = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_good", "_web"))
            kept = np.flatnonzero(good | web)
            if len(kept):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values[kept].ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
                blank = pa.array(np.full(len(kept), -1, np.int32))
                columns = [blank, blank, pa.array(np.ones(len(kept), np.int64)), batch.column("_fold").take(pa.array(kept)), pa.array(good[kept]), pa.array(web[kept]), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "cell", "n", "fold", "good", "web", "values"])
        if counts is not None:
            feature, cell = np.nonzero(counts)
            none = lambda kind: pa.nulls(len(cell), kind)
            columns = [pa.array(feature.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[feature, cell]), none(pa.int32()), none(pa.bool_()), none(pa.bool_()), none(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "cell", "n", "fold", "good", "web", "values"])

    return marked.mapInArrow(lean(task), _GATHERED)


def _sample(gathered: DataFrame, most_positive: int, most_unlabelled: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Feature rows of positives and unlabelled, and their folds, in an order that no plan changes.

    Rows repeated many times are one row of the sample, so that no id fills it.
    """
    rows = gathered.filter("feature < 0").groupBy("fold", "good", "web", "values").count()
    order = F.xxhash64("values", "fold")
    found = []
    for kind, most in (("good", most_positive), ("web", most_unlabelled)):
        table = rows.filter(kind).orderBy(order, "values", "fold").limit(most).select("fold", "values").toArrow()
        width = len(table["values"][0]) if len(table) else 1
        found.append((np.array(table["values"].combine_chunks().flatten(), float).reshape(-1, width), table["fold"].to_numpy().astype(np.int64)))
    return found[0][0], found[1][0], (found[0][1], found[1][1])


def _prior_of_all(marked: DataFrame, plain: Plain, positive_scores: np.ndarray) -> float:
    """The class prior from the scores of all rows, each by the model that has not seen its fold."""
    shared = marked.sparkSession.sparkContext.broadcast(plain)
    cuts = np.unique(np.quantile(positive_scores, np.linspace(0, 0.95, 192)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            if len(batch):
                scores = left_out_scores(shared.value, _text_features(batch.column("text")), batch.column("_fold").to_numpy())
                counts += np.bincount(np.searchsorted(cuts, scores, side="right"), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], names=["cell", "n"])

    counts = np.zeros(len(cuts) + 1, np.int64)
    for r in marked.mapInArrow(lean(task), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row per cut
        counts[r.cell] = r.n
    above = counts[::-1].cumsum()[::-1] / max(counts.sum(), 1)
    above_p = np.concatenate([[1.0], _above(positive_scores, cuts)])
    return prior_from_shares(above_p, above, len(positive_scores), int(counts.sum()))


def score_texts(docs: DataFrame, model: Broadcast, keep: list[str], text: str = "text", least: float | None = None) -> DataFrame:
    """The columns ``keep`` of every row with ``score``; with ``least``, only rows that reach it.

    A null or empty text has a score as well, that of a text without characters. Rows are
    independent: repeated rows get equal scores, an empty table gives none. ``keep`` must
    not hold a column named ``score``.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(model.value, _text_features(batch.column(text))) if len(batch) else np.zeros(0)
            columns = [*(batch.column(c) for c in keep), pa.array(scores)]
            rows = pa.RecordBatch.from_arrays(columns, names=[*keep, "score"])
            yield rows if least is None else rows.filter(pa.array(scores >= least))

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(task), schema)


def keep_good(docs: DataFrame, model: Broadcast, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the score, with their own columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    good = score_texts(inner, model, inner.columns, f"c{names.index(text)}", least)
    return good.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
