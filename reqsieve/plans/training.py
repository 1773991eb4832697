"""Training: split, index, one-hot, assemble, elastic-net logistic regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.operators.vocabulary import attach_index, sizes, vocabulary
from reqsieve.plans import tabled
from reqsieve.schemas import LABEL
from reqsieve.session import cut_lineage
from reqsieve.sizing import BROADCAST_BYTES, fits, join_side

# Split shares and the regression's settings.
SPLIT = (0.8, 0.1, 0.1)
MAX_ITER = 300
REG_PARAM = 0.3
ELASTIC_NET_PARAM = 7.482741259139502e-05

CATEGORICAL = ("publisherId", "country", "gender", "brand", "conType")
NUMERIC = ("age", "height", "width", "withBundleId", "withGeo", "rtbFloorPriceSent")
FEATURES = "features"
#: Coefficients up to which Spark ML's regression is used, which keeps its vectors whole on the driver and in each task.
DRIVER_SLOTS = 1 << 16


@dataclass(frozen=True)
class Splits:
    train: DataFrame
    cv: DataFrame
    test: DataFrame

    def persist(self) -> Splits:
        """Keep the three parts in memory, spilling to disk."""
        for part in (self.train, self.cv, self.test):
            part.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for part in (self.train, self.cv, self.test):
            part.unpersist()


def random_split(df: DataFrame, weights: Sequence[float] = SPLIT, seed: int | None = None) -> Splits:
    """Three random parts of a table, drawn anew by each reader; ``stored_split`` draws once.

    Each part draws the rows again, so ``df`` should be read from files (a scan
    or a written table) to give every draw the same partitions; after joins or
    groupings write it first, or use ``hash_split``.
    """
    return Splits(*df.randomSplit(list(weights), seed))


def stored_split(df: DataFrame, path: str, weights: Sequence[float] = SPLIT, seed: int | None = None) -> Splits:
    """Three random parts, drawn once and written as one table; each part reads its own files."""
    names = ("train", "cv", "test")
    draw = F.rand(seed) * sum(weights)
    part = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], (weights[0], weights[0] + weights[1])))):
        part = F.when(F.col("_draw") < bound, name).otherwise(part)
    df.withColumn("_draw", draw).withColumn("_part", part).drop("_draw").write.partitionBy("_part").parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.StringType())])).parquet(path)
    return Splits(*[stored.filter(F.col("_part") == name).drop("_part") for name in names])


def hash_bucket(key: Column | str, buckets: int = 10) -> Column:
    """A row's bucket from its key alone: the same on every run and engine."""
    key = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % buckets


def hash_part(key: Column | str) -> Column:
    """``train`` for buckets 0-7, ``cv`` for 8, ``test`` for 9."""
    bucket = hash_bucket(key)
    return F.when(bucket < 8, "train").when(bucket == 8, "cv").otherwise("test")


def hash_split(df: DataFrame, key: Column | str) -> Splits:
    """80/10/10 by key. Use a key that is unique per request."""
    return Splits(*[df.filter(hash_part(key) == name) for name in ("train", "cv", "test")])


def _index(name: str) -> str:
    return f"{name}_index"


def _vector(name: str) -> str:
    return f"{name}_vector"


class TooManyCategories(ValueError):
    """The categories do not fit a Spark ML indexer; ``fit``, ``fit_wide``, ``indexed`` and ``tune`` take any number."""


def complete(rows: DataFrame, numeric: Sequence[str] = NUMERIC, label: str = LABEL) -> DataFrame:
    """Rows that can be learned from: no number and no label is null or NaN."""
    whole = F.lit(True)
    for name in (*numeric, label):
        whole = whole & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    return rows.filter(whole)


def fit_indexers(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL, handle_invalid: str = "skip", limit: int = BROADCAST_BYTES
) -> list[StringIndexerModel]:
    """One indexer per column, all from one pass: categories by falling frequency,
    ties in text order.

    ``skip`` is set on the fitted models: rows with an unseen category are left
    out of training. An indexer keeps its labels on the driver and in every
    task, so their bytes are counted first.
    """
    return _indexers(cut_lineage(vocabulary(df, columns), "categories"), columns, handle_invalid, limit)


def _indexers(known: DataFrame, columns: Sequence[str], handle_invalid: str = "skip", limit: int = BROADCAST_BYTES) -> list[StringIndexerModel]:
    if not fits(known, limit):
        raise TooManyCategories(f"more than {limit} bytes of categories in {', '.join(columns)}")
    rows = known.orderBy("feature", "idx").collect()
    return [
        StringIndexerModel.from_labels([r.category for r in rows if r.feature == c], c, _index(c), handle_invalid)
        for c in columns
    ]


def one_hot(columns: Sequence[str] = CATEGORICAL) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[_index(c) for c in columns], outputCols=[_vector(c) for c in columns])


def _assembler(categorical: Sequence[str], numeric: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[*numeric, *map(_vector, categorical)], outputCol=FEATURES, handleInvalid="skip")


def indexed(rows: DataFrame, source: DataFrame, columns: Sequence[str] = CATEGORICAL, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with an index per column, by Spark ML's indexers or, beyond ``limit`` bytes of categories, by joins."""
    try:
        return PipelineModel(fit_indexers(source, columns, limit=limit)).transform(rows)
    except TooManyCategories:
        return Encoding.of(source, columns, ()).index(rows)


def regression(label: str = LABEL) -> LogisticRegression:
    return LogisticRegression(featuresCol=FEATURES, labelCol=label)


def overrides(lr: LogisticRegression, **values: float) -> dict:
    """Param map for ``fit`` from plain names."""
    return {lr.getParam(name): value for name, value in values.items()}


def _settings(params: Mapping[str, float] | None) -> dict[str, float]:
    defaults = {"maxIter": MAX_ITER, "regParam": REG_PARAM, "elasticNetParam": ELASTIC_NET_PARAM}
    return {**defaults, **(params or {})}


def fit(
    train: DataFrame,
    source: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    label: str = LABEL,
    params: Mapping[str, float] | None = None,
    limit: int = BROADCAST_BYTES,
) -> PipelineModel | WideModel | TableModel:
    """Fit the whole pipeline on ``train``; where the categories exceed ``limit`` bytes, which
    Spark ML's indexers would keep on the driver, go on by joins like ``fit_wide``.

    Rows with a null number or label are left out, as rows with an unseen
    category are; ``left_out`` counts both. The categories come from ``source``: pass the full data set to know the
    categories of the held-out parts too, or ``train`` itself.
    """
    lr, encoding = regression(label), Encoding.of(source, categorical, numeric)
    stages = [_assembler(categorical, numeric)]
    if categorical:
        try:
            stages = [*_indexers(encoding.known, categorical, limit=limit), one_hot(categorical), *stages]
        except TooManyCategories:
            return _fit_encoding(train, encoding, label, params)
    pipeline = Pipeline(stages=[*stages, lr])
    return pipeline.fit(complete(train, numeric, label), overrides(lr, **_settings(params)))


@dataclass(frozen=True)
class WideModel:
    """A regression over categories kept in a table instead of on the driver."""

    regression: LogisticRegressionModel
    encoding: Encoding

    @property
    def categories(self) -> DataFrame:
        return self.encoding.known

    @property
    def sizes(self) -> Mapping[str, int]:
        return {c: self.encoding.sizes[c][0] for c in self.encoding.categorical}

    @property
    def numeric(self) -> Sequence[str]:
        return self.encoding.numeric

    def transform(self, rows: DataFrame, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """Predictions for the rows that are complete and of known categories."""
        return self.regression.transform(self.encoding.assemble(rows, keep))

    def pipeline(self) -> PipelineModel:
        """The stages after indexing, as Spark ML stores them."""
        return PipelineModel([*self.encoding.stages(), self.regression])


@dataclass(frozen=True)
class TableModel:
    """A regression whose coefficients are a table too: ``entries``, ``(feature, category, coefficient)``."""

    intercept: float
    numeric_weights: Mapping[str, float]
    entries: DataFrame
    encoding: Encoding
    iterations: int

    @classmethod
    def of(cls, fitted: tabled.Fitted, encoding: Encoding) -> TableModel:
        named = dict(zip(encoding.categorical, range(len(encoding.categorical))))
        number = F.lit(None).cast("long")
        for feature, k in named.items():
            number = F.when(F.col("feature") == feature, tabled.slot(k, F.col("idx"))).otherwise(number)
        known = encoding.known.select("feature", "category", number.alias("slot")) if named else encoding.known
        entries = known
        if named:
            entries = known.join(join_side(fitted.weights), "slot", "left")
            entries = entries.select("feature", "category", F.coalesce("weight", F.lit(0.0)).alias("coefficient"))
            entries = cut_lineage(entries, "entries")
        return cls(fitted.intercept, dict(zip(encoding.numeric, fitted.numbers)), entries, encoding, fitted.iterations)

    def transform(self, rows: DataFrame, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """Predictions for the rows that are complete and of known categories; ``rawPrediction`` is the margin."""
        numeric, categorical = self.encoding.numeric, self.encoding.categorical
        columns = dict.fromkeys([*numeric, *categorical, *keep])
        rows = complete(rows.select(*columns), numeric, numeric[0] if numeric else keep[0])
        margin = F.lit(self.intercept)
        for name, weight in self.numeric_weights.items():
            margin = margin + F.lit(weight) * F.col(name).cast("double")
        for k, name in enumerate(categorical):
            side = self.entries.filter(F.col("feature") == name).select(F.col("category").alias(f"__c{k}"), F.col("coefficient").alias(f"__w{k}"))
            side = join_side(side, known_bytes=self.encoding.sizes[name][1])
            rows = rows.join(side, F.col(name).cast("string") == F.col(f"__c{k}"))
            margin = margin + F.col(f"__w{k}")
        scored = rows.select(*keep, margin.alias("rawPrediction"))
        return scored.withColumn("prediction", (F.col("rawPrediction") > 0).cast("double"))


@dataclass(frozen=True)
class Encoding:
    """Indexing by joins, one-hot and assembly, for any number of categories.

    ``sizes``: categories and bytes of each feature, counted in one job.
    """

    known: DataFrame
    sizes: Mapping[str, tuple[int, int]]
    categorical: Sequence[str]
    numeric: Sequence[str]

    @classmethod
    def of(cls, source: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> Encoding:
        if not categorical:
            return cls(source.limit(0), {}, (), tuple(numeric))
        known = cut_lineage(vocabulary(source, categorical), "categories")
        return cls(known, {c: (0, 0) for c in categorical} | sizes(known), tuple(categorical), tuple(numeric))

    def index(self, rows: DataFrame) -> DataFrame:
        for column in self.categorical:
            count, used = self.sizes[column]
            rows = attach_index(rows, self.known, column, _index(column), known_bytes=used)
            # The encoder takes its width from here instead of scanning for it.
            nominal = {"ml_attr": {"type": "nominal", "num_vals": count}}
            rows = rows.withColumn(_index(column), F.col(_index(column)).alias(_index(column), metadata=nominal))
        return rows

    @property
    def slots(self) -> int:
        """Coefficients of a regression over these features."""
        return len(self.numeric) + sum(max(self.sizes[c][0] - 1, 0) for c in self.categorical)

    def encode(self, rows: DataFrame, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
        """The rows that can be used, as ``tabled.fit`` reads them."""
        columns = dict.fromkeys([*self.numeric, *self.categorical, label, *keep])
        ready = self.index(complete(rows.select(*columns), self.numeric, label))
        return tabled.encode(ready, label, self.numeric, [_index(c) for c in self.categorical], self._counts(), keep)

    def _counts(self) -> list[int]:
        return [self.sizes[c][0] for c in self.categorical]

    def fit_encoded(self, encoded: DataFrame, settings: Mapping[str, float]) -> TableModel:
        return self.fit_each_encoded(encoded, [settings])[0]

    def fit_each_encoded(self, encoded: DataFrame, settings: Sequence[Mapping[str, float]]) -> list[TableModel]:
        return [TableModel.of(fitted, self) for fitted in tabled.fit_each(encoded, len(self.numeric), self._counts(), settings)]

    def stages(self) -> list:
        stages = [one_hot(self.categorical)] if self.categorical else []
        blank = [F.lit(0.0).alias(_index(c), metadata={"ml_attr": {"type": "nominal", "num_vals": self.sizes[c][0]}}) for c in self.categorical]
        numbers = [F.lit(0.0).alias(n) for n in self.numeric]
        shape = self.known.sparkSession.range(0).select(*blank, *numbers)
        return Pipeline(stages=[*stages, _assembler(self.categorical, self.numeric)]).fit(shape).stages

    def assemble(self, rows: DataFrame, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """``features`` and the columns ``keep`` of the rows that can be used."""
        columns = dict.fromkeys([*self.numeric, *self.categorical, *keep])
        indexed = self.index(complete(rows.select(*columns), self.numeric, self.numeric[0] if self.numeric else keep[0]))
        return PipelineModel(self.stages()).transform(indexed).select(FEATURES, *keep)


def left_out(rows: DataFrame, encoding: Encoding, label: str = LABEL) -> dict[str, int]:
    """How many rows are used, and how many are not for want of a number, a label or a known category."""
    whole = complete(rows, encoding.numeric, label)
    total, usable = rows.count(), whole.count()
    used = encoding.index(whole.select(*encoding.categorical, label)).count() if encoding.categorical else usable
    return {"rows_used": used, "rows_null": total - usable, "rows_unseen": usable - used}


def fit_wide(
    train: DataFrame,
    source: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    label: str = LABEL,
    params: Mapping[str, float] | None = None,
) -> WideModel | TableModel:
    """The same fit for any number of categories.

    Categories are indexed by joins. Beyond ``DRIVER_SLOTS`` coefficients the
    regression keeps them in a table (``tabled``).
    """
    return _fit_encoding(train, Encoding.of(source, categorical, numeric), label, params)


def _fit_encoding(train: DataFrame, encoding: Encoding, label: str, params: Mapping[str, float] | None) -> WideModel | TableModel:
    if encoding.slots > DRIVER_SLOTS:
        return encoding.fit_encoded(cut_lineage(encoding.encode(train, label), "features"), _settings(params))
    lr = regression(label)
    ready = encoding.assemble(complete(train, encoding.numeric, label), [label])
    return WideModel(lr.fit(ready, overrides(lr, **_settings(params))), encoding)


@dataclass(frozen=True)
class Trial:
    params: Mapping[str, float]
    area_under_roc: float
    model: WideModel | TableModel
    share: float = 1.0  # of the training part that it was fitted on


#: Settings that are tried side by side.
FITS_AT_ONCE = 4


def _area(label: str) -> BinaryClassificationEvaluator:
    # No binning: the area over all distinct scores.
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)


def tune(
    splits: Splits,
    source: DataFrame,
    grid: Mapping[str, Sequence[float]],
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    label: str = LABEL,
    params: Mapping[str, float] | None = None,
    encoding: Encoding | None = None,
) -> list[Trial]:
    """Fit every grid point on the whole training part and rank them on the whole cv part, the best first.

    The features are made once, and written; all fits read them, some at
    a time. ``params`` are the settings that the grid leaves alone.
    """
    encoding = encoding or Encoding.of(source, categorical, numeric)
    parts = [complete(part, numeric, label) for part in (splits.train, splits.cv)]
    if in_table := encoding.slots > DRIVER_SLOTS:
        made = [encoding.encode(parts[0], label), parts[1].select(*dict.fromkeys([*numeric, *categorical, label]))]
    else:
        made = [encoding.assemble(part, [label]) for part in parts]
    ready = [cut_lineage(part, "features") for part in made]  # a fit keeps its rows in memory by itself
    judge, lr = _area(label), regression(label)
    points = [{**_settings(params), **dict(zip(grid, values))} for values in product(*grid.values())]
    if in_table:
        models = [m for k in range(0, len(points), FITS_AT_ONCE) for m in encoding.fit_each_encoded(ready[0], points[k : k + FITS_AT_ONCE])]
    else:
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            fits = [pool.submit(inheritable_thread_target(source.sparkSession)(lr.fit), ready[0], overrides(lr, **settings)) for settings in points]
            models = [fit.result() for fit in fits]
    areas = [judge.evaluate(model.transform(ready[1], [label]) if in_table else model.transform(ready[1])) for model in models]
    trials = [Trial(s, area, m if in_table else WideModel(m, encoding)) for s, area, m in zip(points, areas, models)]
    return sorted(trials, key=lambda t: -t.area_under_roc)


def evaluate(model: PipelineModel | WideModel | TableModel, test: DataFrame, label: str = LABEL) -> dict[str, float]:
    """Area under ROC and accuracy on a held-out part, and the share of its rows that could be
    evaluated (``coverage``): the others have a null or an unseen category."""
    scored = model.transform(test).select(label, "rawPrediction", "prediction").filter(F.col(label).isNotNull()).persist()
    try:
        area = _area(label).evaluate(scored)
        right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
        accuracy, evaluated = scored.agg(right, F.count(F.lit(1))).first()
    finally:
        scored.unpersist()
    total = test.count()
    return {"area_under_roc": area, "accuracy": accuracy, "coverage": evaluated / total if total else 0.0}
